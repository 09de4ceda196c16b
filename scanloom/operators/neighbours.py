"""Neighbourhoods of map points.

A map is cut into square tiles, and a point goes to its own tile and to those whose edge it is near. So with tiles of T
points and a window that reaches h of them, (1 + 2h / T)^2 times the patterns shuffle once, not once for each neighbour.
A tile has (T + 2h)^2 points at most, whatever the size of the map, so no map can be too large for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from scanloom.functions import pixels as px
from scanloom.functions.windows import Window
from scanloom.kernels import images
from scanloom.kernels.blocks import from_block, to_block

#: Points along a tile's side.
TILE = 32


def map_tiles(df: DataFrame, reach: tuple[int, int], kernel: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: StructType, maps: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """``kernel(rows, grid, home)`` for each tile of each map (``maps``: the columns that tell maps apart).

    rows are the tile's points and those within ``reach`` of it; grid has the row at each place of the tile with its
    margin, -1 where there is none; home lists the rows of the tile itself, for which the kernel gives results. Rows without
    y or x lie on no map and are left out. Two rows at one point of a map are an error: neither could be its neighbours'.
    """
    ry, rx = reach
    near = lambda c, r: F.sequence(F.floor((F.col(c) - r) / tile), F.floor((F.col(c) + r) / tile))
    placed = df.withColumn("_ty", F.explode(near("y", ry))).withColumn("_tx", F.explode(near("x", rx)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        ty, tx = table.column("_ty")[0].as_py(), table.column("_tx")[0].as_py()
        y, x = (table.column(c).to_numpy().astype(np.int64) - t * tile + r for c, t, r in (("y", ty, ry), ("x", tx, rx)))
        grid = np.full((tile + 2 * ry, tile + 2 * rx), -1)
        grid[y, x] = np.arange(table.num_rows)
        if (grid >= 0).sum() < table.num_rows:
            at = np.flatnonzero(grid[y, x] != np.arange(table.num_rows))[0]
            raise ValueError(f"several rows are at y={y[at] + ty * tile - ry}, x={x[at] + tx * tile - rx} of a map")
        home = np.flatnonzero((y >= ry) & (y < ry + tile) & (x >= rx) & (x < rx + tile))
        if not len(home):  # a tile of margins only
            return to_arrow_schema(schema).empty_table()
        return kernel(table.drop_columns(["_ty", "_tx"]), grid, home)

    return placed.groupBy(*maps, "_ty", "_tx").applyInArrow(run, schema)


def _shifted(grid: np.ndarray, table: pa.Table, home: np.ndarray, reach: tuple[int, int], tile: int) -> Callable[[int, int], np.ndarray]:
    """f(dy, dx): for each home row the row at that distance, or -1."""
    where = np.full(table.num_rows, -1)
    flat = grid.ravel()
    where[flat[flat >= 0]] = np.flatnonzero(flat >= 0)
    at = where[home]
    return lambda dy, dx: flat[at + dy * grid.shape[1] + dx]


def _reach(offsets: list[tuple[int, int, float]]) -> tuple[int, int]:
    return max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)


def average_neighbour_patterns(df: DataFrame, shape: tuple[int, int], window: Window | None = None, out_range: tuple[float, float] = (-1, 1), dtype_out: str | None = None, maps: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Each pattern replaced by the weighted mean of those in the window around its point, rescaled. Points outside the map
    and null patterns don't count; a pattern whose mean is constant, or that is null itself, gives null."""
    offsets = (window or Window("circular", (3, 3))).offsets()
    to = px.dtype_range(dtype_out) if dtype_out else out_range
    size, reach = shape[0] * shape[1], _reach(offsets)
    schema = StructType([StructField(f.name, ArrayType(DoubleType())) if f.name == "pixels" else f for f in df.schema])

    def kernel(table: pa.Table, grid: np.ndarray, home: np.ndarray) -> pa.Table:
        block, whole = to_block(table.column("pixels").combine_chunks(), size)
        all_ = np.zeros((len(whole), size))
        all_[whole] = block
        at = _shifted(grid, table, home, reach, tile)
        sums, weights = np.zeros((len(home), size)), np.zeros(len(home))
        for dy, dx, w in offsets:
            row = at(dy, dx)
            ok = (row >= 0) & whole[row]
            sums[ok] += w * all_[row[ok]]
            weights[ok] += w
        mine = whole[home]
        with np.errstate(invalid="ignore", divide="ignore"):
            means = (sums / weights[:, None])[mine]
        pixels = images.rescale(means.reshape(-1, *shape), to).reshape(len(means), size)
        out = table.take(pa.array(home))
        return out.set_column(out.schema.get_field_index("pixels"), "pixels", from_block(pixels, mine, pa.list_(pa.float64())))

    out = map_tiles(df, reach, kernel, schema, maps, tile)
    return out if dtype_out is None else out.withColumn("pixels", px.to_dtype(F.col("pixels"), dtype_out))


def neighbour_dot_products(df: DataFrame, shape: tuple[int, int], window: Window | None = None, zero_mean: bool = True, normalize: bool = True, maps: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The map columns and ``dot_products``: the window around each point in row-major order, with the dot product of the
    point's pattern and each neighbour's; null outside the map and where the window is 0."""
    window = window or Window("circular", (3, 3))
    grid_shape = np.atleast_2d(window.values).shape
    offsets = window.offsets()
    size, reach = shape[0] * shape[1], _reach(offsets)
    oy, ox = (0, *window.origin)[-2:]
    kept = [f for f in df.schema if f.name != "pixels"]
    schema = StructType([*kept, StructField("dot_products", ArrayType(DoubleType()))])

    def kernel(table: pa.Table, grid: np.ndarray, home: np.ndarray) -> pa.Table:
        block, whole = to_block(table.column("pixels").combine_chunks(), size)
        if zero_mean:
            block = block - block.mean(axis=1, keepdims=True)
        if normalize:
            with np.errstate(invalid="ignore", divide="ignore"):
                block = block / np.linalg.norm(block, axis=1, keepdims=True)
        all_ = np.full((len(whole), size), np.nan)
        all_[whole] = block
        at = _shifted(grid, table, home, reach, tile)
        out = np.full((len(home), *grid_shape), np.nan)
        for dy, dx, _ in offsets:
            row = at(dy, dx)
            ok = row >= 0
            out[ok, dy + oy, dx + ox] = np.einsum("ij,ij->i", all_[home[ok]], all_[row[ok]])
        flat = out.reshape(len(home), -1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel(), mask=np.isnan(flat.ravel())), flat.shape[1]).cast(pa.list_(pa.float64()))
        mine = table.take(pa.array(home)).drop_columns(["pixels"])
        return mine.append_column("dot_products", lists)

    return map_tiles(df, reach, kernel, schema, maps, tile)


def average_neighbour_dot_product(df: DataFrame, shape: tuple[int, int], window: Window | None = None, zero_mean: bool = True, normalize: bool = True, maps: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The map columns and ``adp``, the mean of the dot products with the neighbours in the window, the point itself left
    out; null for a point without neighbours."""
    window = window or Window("circular", (3, 3))
    products = neighbour_dot_products(df, shape, window, zero_mean, normalize, maps, tile)
    return average_of_dot_products(products, window)


def average_of_dot_products(products: DataFrame, window: Window) -> DataFrame:
    """``adp`` from the ``dot_products`` of the same window."""
    width = np.atleast_2d(window.values).shape[1]
    oy, ox = (0, *window.origin)[-2:]
    others = px.let(lambda s: F.when(F.size(s["o"]) > 0, px.mean(s["o"])), o=F.filter("dot_products", lambda v, i: v.isNotNull() & (i != oy * width + ox)))
    return products.withColumn("adp", others).drop("dot_products")


def orientation_similarity_map(xmap: DataFrame, n_best: int | None = None, normalize: bool = False, from_n_best: int | None = None, window: Window | None = None, indices: str = "simulation_indices", maps: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """The map columns and ``osm``: the mean over the neighbours in the window (by default the four nearest) of how many of
    the best ``n_best`` indices a point shares with them, over n_best if normalised. With ``from_n_best`` it is an array for
    n_best, n_best - 1, ... from_n_best. Indices count once; null for a point without neighbours."""
    offsets = [(dy, dx) for dy, dx, _ in (window or Window("circular", (3, 3))).offsets() if (dy, dx) != (0, 0)]
    reach = max(abs(o[0]) for o in offsets), max(abs(o[1]) for o in offsets)
    kept = [f for f in xmap.schema if f.name in ("idx", "y", "x") or f.name in maps]
    schema = StructType([*kept, StructField("osm", ArrayType(DoubleType()))])
    narrow = xmap.select(*[f.name for f in kept], F.col(indices).cast(ArrayType(LongType())).alias("_indices"))

    def kernel(table: pa.Table, grid: np.ndarray, home: np.ndarray) -> pa.Table:
        lists = table.column("_indices").to_pylist()
        longest = n_best or max((len(v) for v in lists if v), default=0)
        sizes = list(range(longest, (from_n_best or longest) - 1, -1)) or [0]
        there = np.array([v is not None for v in lists], bool)
        # an absent index is unlike any other: its own place below zero
        best = -1 - np.arange(table.num_rows * max(longest, 1), dtype=np.int64).reshape(table.num_rows, -1)
        used = np.zeros(best.shape, bool)
        for k, v in enumerate(lists):
            n = min(len(v), longest) if v else 0
            best[k, :n], used[k, :n] = v[:n] if n else [], True
        rank = np.arange(best.shape[1])
        again = ((best[:, :, None] == best[:, None, :]) & (rank[None, None, :] < rank[None, :, None])).any(axis=2)
        at = _shifted(grid, table, home, reach, tile)
        sums, count = np.zeros((len(home), len(rank) + 1)), np.zeros(len(home), int)
        for dy, dx in offsets:
            row = at(dy, dx)
            ok = np.flatnonzero((row >= 0) & there[row] & there[home])
            mine, other = home[ok], row[ok]
            same = (best[mine][:, :, None] == best[other][:, None, :]) & used[mine][:, :, None] & used[other][:, None, :]
            # an index is shared from the rank on at which both lists have it
            when = np.where(same.any(axis=2) & ~again[mine], np.maximum(rank, same.argmax(axis=2)), len(rank))
            shared = np.zeros((len(ok), len(rank) + 1))
            np.add.at(shared, (np.repeat(np.arange(len(ok)), len(rank)), when.ravel()), 1)
            sums[ok, 1:] += np.cumsum(shared, axis=1)[:, :-1]
            count[ok] += 1
        with np.errstate(invalid="ignore", divide="ignore"):
            means = sums[:, [min(n, len(rank)) for n in sizes]] / count[:, None] / (np.maximum(sizes, 1) if normalize else 1)
        out = [m.tolist() if c else None for m, c in zip(means, count, strict=True)]
        return table.take(pa.array(home)).drop_columns(["_indices"]).append_column("osm", pa.array(out, pa.list_(pa.float64())))

    out = map_tiles(narrow, reach, kernel, schema, maps, tile)
    return out if from_n_best is not None else out.withColumn("osm", F.get("osm", F.lit(0)))
