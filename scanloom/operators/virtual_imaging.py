"""Virtual detectors: maps of the intensity in regions of the patterns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import pixels as px

Region = tuple[int, int, int, int]


def virtual_image(df: DataFrame, shape: tuple[int, int], region: Region, column: str = "pixels", name: str = "v") -> DataFrame:
    """Adds the sum of the pixels in (top, bottom, left, right), ends excluded. Row-local; only the map columns are left."""
    return df.withColumn(name, px.region_sum(F.col(column), shape, *region)).drop(column)


@dataclass(frozen=True)
class VirtualImager:
    """A detector divided into grid_shape tiles. Fractional tile edges are rounded down."""

    shape: tuple[int, int]
    grid_shape: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        grid = self.grid_shape or tuple(min(5, n) for n in self.shape)
        if any(g < 1 or g > n for g, n in zip(grid, self.shape, strict=True)):
            raise ValueError(f"a grid of shape {grid} doesn't fit patterns of shape {self.shape}")
        object.__setattr__(self, "grid_shape", grid)

    @property
    def grid_rows(self) -> np.ndarray:
        return np.linspace(0, self.shape[0], self.grid_shape[0] + 1)

    @property
    def grid_cols(self) -> np.ndarray:
        return np.linspace(0, self.shape[1], self.grid_shape[1] + 1)

    def region(self, tiles: tuple[int, int] | Sequence[tuple[int, int]]) -> Region:
        """The rectangle around one or several tiles (row, column)."""
        at = np.atleast_2d(np.array(tiles))
        (r0, c0), (r1, c1) = at.min(axis=0), at.max(axis=0)
        rows, cols = self.grid_rows, self.grid_cols
        return int(rows[r0]), int(rows[r1 + 1]), int(cols[c0]), int(cols[c1 + 1])

    def images(self, df: DataFrame, column: str = "pixels") -> DataFrame:
        """One row per map point and tile: the map columns, grid_r, grid_c, v. All tiles come from one pass."""
        tiles = [(r, c, *self.region((r, c))) for r in range(self.grid_shape[0]) for c in range(self.grid_shape[1])]
        sums = F.array(*[F.struct(F.lit(r).alias("grid_r"), F.lit(c).alias("grid_c"), px.region_sum(F.col(column), self.shape, *region).alias("v")) for r, c, *region in tiles])
        keys = [c for c in df.columns if c != column]
        return df.select(*keys, F.inline(sums))

    def rgb(self, df: DataFrame, red, green, blue, percentiles: tuple[float, float] | None = None, normalize: bool = True, alpha: str | None = None, dtype_out: str = "uint8", add_bright: int = 0, contrast: float = 1.0, column: str = "pixels") -> DataFrame:
        """The map columns and r, g, b: sums of tiles or regions (each channel one, or a list of them), normalised over the
        map, times ``alpha`` (a column) scaled to its extremes, stretched to the range of ``dtype_out``.

        The statistics of a map are exact; medians and percentiles come from counts of distinct sums, combined by tasks.
        """
        if dtype_out not in ("uint8", "uint16"):
            raise ValueError("images are uint8 or uint16")
        top = px.dtype_range(dtype_out)[1]
        out = df.withColumns({n: self._channel(c, column) for n, c in zip("rgb", (red, green, blue), strict=True)}).drop(column)
        names = out.columns
        if normalize:
            stats = out.agg(*[f(n).alias(f"_{n}_{k}") for n in "rgb" for k, f in (("mid", lambda c: F.percentile(c, F.lit(0.5))), ("std", F.stddev_pop))])
            out = out.join(F.broadcast(stats))
            for n in "rgb":
                v = top // 2 + add_bright + contrast * top * 0.3125 * (F.col(n) - F.col(f"_{n}_mid")) / F.col(f"_{n}_std")
                out = out.withColumn(n, F.when(F.col(f"_{n}_std") > 0, F.greatest(F.least(v, F.lit(float(top))), F.lit(0.0))))
            out = out.select(*names)
        if alpha is not None:
            ends = out.agg(F.min(alpha).alias("_lo"), F.max(alpha).alias("_hi"))
            out = out.join(F.broadcast(ends))
            out = out.withColumns({n: F.col(n) * (F.col(alpha) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) for n in "rgb"}).select(*names)
        stack = out.select(F.explode(F.array("r", "g", "b")).alias("v"))
        lo, hi = (F.percentile("v", F.lit(q / 100)) for q in percentiles) if percentiles else (F.min("v"), F.max("v"))
        out = out.join(F.broadcast(stack.agg(lo.alias("_lo"), hi.alias("_hi"))))
        stretched = {n: (F.greatest(F.least(F.col(n), F.col("_hi")), F.col("_lo")) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")) * float(top) for n in "rgb"}
        return out.withColumns(stretched).select(*names)

    def _channel(self, tiles, column: str) -> Column:
        regions = [tiles] if isinstance(tiles, tuple) else list(tiles)
        regions = [self.region(t) if len(t) == 2 else t for t in regions]
        return sum((px.region_sum(F.col(column), self.shape, *r) for r in regions[1:]), px.region_sum(F.col(column), self.shape, *regions[0]))


def rescale_image(df: DataFrame, out_range: tuple[float, float] = (-1.0, 1.0), in_range: tuple[float, float] | None = None, percentiles: tuple[float, float] | None = None, maps: Sequence[str] = (), column: str = "v") -> DataFrame:
    """A virtual image, one row per map point, from its extremes (or ``in_range``, or percentiles of it, clipped) to
    ``out_range``. An image without contrast gives null. ``maps``: the columns that tell images apart."""
    v = F.col(column)
    if in_range is not None:
        ends = None
        lo, hi = F.lit(float(in_range[0])), F.lit(float(in_range[1]))
    else:
        which = [F.min(v), F.max(v)] if percentiles is None else [F.percentile(v, p / 100) for p in percentiles]
        ends = df.groupBy(*[F.col(m).alias(f"_{m}") for m in maps]).agg(which[0].alias("_lo"), which[1].alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
    part = F.when(hi > lo, (F.greatest(F.least(v, hi), lo) - lo) / (hi - lo))
    out = _with_ends(df, ends, maps)
    return out.withColumn(column, part * float(out_range[1] - out_range[0]) + float(out_range[0])).select(*df.columns)


def normalize_image(df: DataFrame, num_std: float = 1, maps: Sequence[str] = (), column: str = "v") -> DataFrame:
    """A virtual image to a mean of 0 and a standard deviation of 1 / ``num_std``; null without contrast."""
    v = F.col(column)
    ends = df.groupBy(*[F.col(m).alias(f"_{m}") for m in maps]).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
    out = _with_ends(df, ends, maps)
    return out.withColumn(column, F.when(F.col("_std") > 0, (v - F.col("_mean")) / (num_std * F.col("_std")))).select(*df.columns)


def _with_ends(df: DataFrame, ends: DataFrame | None, maps: Sequence[str]) -> DataFrame:
    if ends is None:
        return df
    if not maps:  # one row
        return df.join(F.broadcast(ends))
    on = None
    for m in maps:
        same = F.col(m).eqNullSafe(F.col(f"_{m}"))
        on = same if on is None else on & same
    return df.join(ends, on)
