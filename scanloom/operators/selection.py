"""Parts of a map and of its patterns. Selections of map points are filters that reach the scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scanloom.functions import pixels as px


def grid_indices(grid_shape: tuple[int, ...] | int, nav_shape: tuple[int, ...] | int, return_spacing: bool = False):
    """Indices of an evenly spaced grid in the middle of a map, one array per axis."""
    grid, nav = (tuple(np.atleast_1d(s).tolist()) for s in (grid_shape, nav_shape))
    if len(grid) != len(nav):
        raise ValueError(f"a grid of shape {grid} and a map of shape {nav} have different dimensions")
    axes, steps = [], []
    for g, n in zip(grid, nav, strict=True):
        step = -(-n // (g + 1))
        at = np.arange(step, n, step)
        axes.append(at - (at[0] - (n - at[-1])) // 2)
        steps.append(step)
    return (axes, tuple(steps)) if return_spacing else axes


def map_shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns that the points of a map reach, counted from 0; one small aggregate."""
    ny, nx = df.agg(F.coalesce(F.max("y") + 1, F.lit(0)), F.coalesce(F.max("x") + 1, F.lit(0))).first()
    return ny, nx


def extract_grid(df: DataFrame, grid_shape: tuple[int, int], nav_shape: tuple[int, int]) -> DataFrame:
    """The map points on a grid; the list of rows and columns is a filter that the scan gets."""
    ys, xs = grid_indices(grid_shape, nav_shape)
    return df.filter(F.col("y").isin(ys.tolist()) & F.col("x").isin(xs.tolist()))


def crop_navigation(df: DataFrame, top: int, bottom: int, left: int, right: int, reset: bool = True) -> DataFrame:
    """Map rows top to bottom and columns left to right, ends excluded; with ``reset`` they count from 0 again."""
    out = df.filter((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right))
    return out.withColumns({"y": F.col("y") - top, "x": F.col("x") - left}) if reset else out


def crop_signal(df: DataFrame, shape: tuple[int, int], top: int, bottom: int, left: int, right: int, column: str = "pixels") -> DataFrame:
    return df.withColumn(column, px.crop(F.col(column), shape, top, bottom, left, right))


def slice_navigation(df: DataFrame, y: slice | int = slice(None), x: slice | int = slice(None)) -> DataFrame:
    """As array indexing of the map with non-negative steps; an index keeps its row or column."""
    out = df
    for name, s in (("y", y), ("x", x)):
        c = F.col(name)
        if isinstance(s, int):
            out = out.filter(c == s)
            continue
        start, step = s.start or 0, s.step or 1
        if start < 0 or step < 1 or (s.stop or 0) < 0:
            raise ValueError("slices of a map count from 0 upwards")
        out = out.filter(c >= start) if start else out
        out = out.filter(c < s.stop) if s.stop is not None else out
        out = out.filter((c - start) % step == 0) if step > 1 else out
    return out


def rebin_navigation(df: DataFrame, factor: tuple[int, int], column: str = "pixels") -> DataFrame:
    """Sums of the patterns of factor[0] x factor[1] map points: y, x, pixels. Points beyond the last whole block add to
    theirs. Patterns are summed per pixel, combined before the shuffle."""
    at = df.select((F.floor(F.col("y") / factor[0])).cast("int").alias("y"), (F.floor(F.col("x") / factor[1])).cast("int").alias("x"), F.posexplode(column).alias("pixel", "v"))
    sums = at.groupBy("y", "x", "pixel").agg(F.sum("v").alias("v"))
    return sums.groupBy("y", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("pixel", "v"))), lambda s: s["v"]).alias(column))


def rebin_signal(df: DataFrame, shape: tuple[int, int], factor: tuple[int, int], column: str = "pixels") -> DataFrame:
    return df.withColumn(column, px.block_sum(F.col(column), shape, factor))


def mask_patterns(df: DataFrame, excluded: np.ndarray, column: str = "pixels") -> DataFrame:
    """Patterns without the pixels for which the mask is true."""
    return df.withColumn(column, px.keep_pixels(F.col(column), excluded))


def roi_is_rectangular(points: DataFrame, y: str = "iy", x: str = "ix") -> DataFrame:
    """One row: ny, nx, is_rectangular, whether the points fill a rectangle of whole rows and columns once each."""
    counts = points.groupBy(y, x).agg(F.count(F.lit(1)).alias("n"))
    # distinct points, so a row or column adds one at most per partial
    ends = counts.agg(
        (F.max(y) - F.min(y) + 1).cast("bigint").alias("ny"), (F.max(x) - F.min(x) + 1).cast("bigint").alias("nx"),
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"),
    )
    return ends.select("ny", "nx", ((F.col("n") == F.col("ny") * F.col("nx")) & (F.col("total") == F.col("n"))).alias("is_rectangular"))


def fill_missing(df: DataFrame, nav_shape: tuple[int, int], n_pixels: int, column: str = "pixels") -> DataFrame:
    """y, x, pixels for every point of the map, zeros where a pattern is absent."""
    ny, nx = nav_shape
    grid = df.sparkSession.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("y"), (F.col("id") % nx).cast("int").alias("x"))
    kind = df.schema[column].dataType
    zeros = F.array_repeat(F.lit(0), n_pixels).cast(kind)
    return grid.join(df.select("y", "x", column), ["y", "x"], "left").withColumn(column, F.coalesce(column, zeros))


def points_in_data(xmap: DataFrame, navigation_mask: Column | None = None) -> DataFrame:
    """Points of a crystal map that are in the data, indexed and not masked. All of them must have one phase."""
    out = xmap.filter("is_in_data and phase_id <> -1")
    out = out if navigation_mask is None else out.filter(~navigation_mask)
    phases = out.select("phase_id").distinct().limit(2).count()
    if phases != 1:
        raise ValueError("the points to use have no phase" if not phases else "the points to use have several phases")
    return out


def nearest_energy(masters: DataFrame, energy: float | tuple[float, float] | None = None) -> DataFrame:
    """Rows of all energies, of a range of energies with its ends, or of the energy nearest to one, the lower on a tie."""
    if energy is None:
        return masters
    if isinstance(energy, tuple):
        return masters.filter(F.col("energy").between(*energy))
    best = masters.agg(F.min(F.struct(F.abs(F.col("energy") - energy).alias("d"), F.col("energy").alias("e")))["e"].alias("_energy"))
    names = masters.columns
    return masters.join(F.broadcast(best), F.col("energy") == F.col("_energy")).select(*names)


def with_row_extremes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exploded pixels with each pattern's least and greatest value, ``lo`` and ``hi``."""
    w = W.partitionBy(*keys)
    return df.withColumns({"lo": F.min(value).over(w), "hi": F.max(value).over(w)})
