"""Intensities of single patterns: rescaling, normalising, background removal, binning, equalisation.

Each takes a table with a ``pixels`` array column and returns it with that column replaced. None of them shuffles, but for
what ``relative`` rescaling and the mean pattern gather: a few numbers, or one pattern, from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import pixels as px
from scanloom.kernels import images
from scanloom.kernels.blocks import doubles, map_patterns
from scanloom.storage import bounded_batches


def _finish(p: Column, dtype_out: str | None) -> Column:
    return p if dtype_out is None or dtype_out == "float64" else px.to_dtype(p, dtype_out)


def _range(dtype_out: str | None, out_range: tuple[float, float] | None) -> tuple[float, float]:
    return tuple(out_range) if out_range is not None else px.dtype_range(dtype_out or "float64")


def rescale_intensity(df: DataFrame, relative: bool = False, in_range: tuple[float, float] | None = None, out_range: tuple[float, float] | None = None, dtype_out: str | None = None, percentiles: tuple[float, float] | None = None, column: str = "pixels") -> DataFrame:
    """Intensities mapped to ``out_range``, or to the range of ``dtype_out``.

    They are mapped from each pattern's extremes; with ``relative`` from the extremes of all patterns; or, clipped, from
    ``in_range`` or from each pattern's ``percentiles``. A constant pattern gives null.
    """
    if relative and (in_range is not None or percentiles is not None) or (in_range is not None and percentiles is not None):
        raise ValueError("relative, in_range and percentiles exclude each other")
    p, to = F.col(column), _range(dtype_out, out_range)
    if percentiles is not None:
        out = px.rescale_percentiles(p, percentiles, to)
    elif relative:
        # two numbers per task, then one row that is sent everywhere
        ends = df.agg(F.min(F.array_min(column)).alias("_lo"), F.max(F.array_max(column)).alias("_hi"))
        names = df.columns
        return df.join(F.broadcast(ends)).withColumn(column, _finish(px.affine(p, F.col("_lo"), F.col("_hi"), to), dtype_out)).select(*names)
    else:
        out = px.rescale(p, to, in_range)
    return df.withColumn(column, _finish(out, dtype_out))


def normalize_intensity(df: DataFrame, num_std: float = 1, divide_by_square_root: bool = False, dtype_out: str | None = None, column: str = "pixels") -> DataFrame:
    """Each pattern less its mean, over ``num_std`` of its standard deviations. A constant pattern gives null."""
    return df.withColumn(column, _finish(px.normalize(F.col(column), num_std, divide_by_square_root), dtype_out))


def mean_pattern(df: DataFrame, column: str = "pixels") -> DataFrame:
    """One row with ``background``, the mean of all patterns. A task adds up its own and sends one pattern; null patterns don't
    count. Without patterns it is null."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            lists = b.column(0).drop_null()
            if len(lists):
                block = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(float)
                total = block.sum(axis=0) if total is None else total + block.sum(axis=0)
                n += len(lists)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], ["total", "n"])

    bounded_batches(df.sparkSession)
    parts = df.select(F.col(column).cast("array<double>")).mapInArrow(summed, "total array<double>, n bigint")
    means = parts.select("n", F.posexplode("total").alias("pixel", "v")).groupBy("pixel").agg((F.sum("v") / F.sum("n")).alias("v"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pixel", "v"))), lambda s: s["v"]).alias("background"))


def remove_static_background(df: DataFrame, background: DataFrame | Sequence[float] | np.ndarray | None = None, operation: str = "subtract", scale_bg: bool = False, dtype_out: str | None = None, out_range: tuple[float, float] | None = None, column: str = "pixels") -> DataFrame:
    """Each pattern less (or over) one background for all, rescaled. The background is an array, a table of one row with a
    column ``background``, or by default the mean of all patterns. It is one pattern, so it is sent everywhere."""
    to = _range(dtype_out, out_range)
    if background is not None and not isinstance(background, DataFrame):
        return df.withColumn(column, _finish(px.remove_background(F.col(column), px.literal(background), operation, to, scale_bg), dtype_out))
    names = df.columns
    background = mean_pattern(df, column) if background is None else background
    joined = df.join(F.broadcast(background.select(F.col("background").alias("_background"))))
    return joined.withColumn(column, _finish(px.remove_background(F.col(column), F.col("_background"), operation, to, scale_bg), dtype_out)).select(*names)


def dynamic_background(df: DataFrame, shape: tuple[int, int], filter_domain: str = "frequency", std: float | None = None, truncate: float = 4.0, column: str = "pixels") -> DataFrame:
    """Each pattern blurred with a Gaussian; ``std`` is an eighth of the columns by default."""
    matrices = images.blur_matrices(shape, filter_domain, std, truncate)
    return map_patterns(df, lambda b: {column: images.blur(b.reshape(-1, *shape), matrices).reshape(len(b), -1)}, doubles(column), shape[0] * shape[1], column)


def remove_dynamic_background(df: DataFrame, shape: tuple[int, int], operation: str = "subtract", filter_domain: str = "frequency", std: float | None = None, truncate: float = 4.0, dtype_out: str | None = None, out_range: tuple[float, float] | None = None, column: str = "pixels") -> DataFrame:
    """Each pattern less (or over) its own blur, rescaled."""
    if operation not in ("subtract", "divide"):
        raise ValueError(f"unknown operation {operation!r}, it is 'subtract' or 'divide'")
    matrices, to = images.blur_matrices(shape, filter_domain, std, truncate), _range(dtype_out, out_range)

    def kernel(b: np.ndarray) -> dict[str, np.ndarray]:
        b = b.reshape(-1, *shape)
        blurred = images.blur(b, matrices)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = b - blurred if operation == "subtract" else b / blurred
        return {column: images.rescale(out, to).reshape(len(b), -1)}

    out = map_patterns(df, kernel, doubles(column), shape[0] * shape[1], column)
    return out.withColumn(column, _finish(F.col(column), dtype_out))


def downsample(df: DataFrame, shape: tuple[int, int], factor: int, dtype_out: str | None = None, out_range: tuple[float, float] | None = None, column: str = "pixels") -> DataFrame:
    """Sums over blocks of factor x factor pixels, rescaled. The factor divides the shape."""
    summed = px.block_sum(F.col(column), shape, (factor, factor))
    return df.withColumn(column, _finish(px.let(lambda s: px.rescale(s["p"], _range(dtype_out, out_range)), p=summed), dtype_out))


def adaptive_histogram_equalization(df: DataFrame, shape: tuple[int, int], kernel_size: tuple[int, int] | None = None, clip_limit: float = 0.0, nbins: int = 128, dtype_out: str | None = None, column: str = "pixels") -> DataFrame:
    """Contrast-limited adaptive histogram equalisation, rescaled to the range of ``dtype_out``."""
    to = _range(dtype_out, None)
    out = map_patterns(df, lambda b: {column: images.rescale(images.clahe(b.reshape(-1, *shape), kernel_size, clip_limit, nbins), to).reshape(len(b), -1)}, doubles(column), shape[0] * shape[1], column)
    return out.withColumn(column, _finish(F.col(column), dtype_out))


def change_dtype(df: DataFrame, dtype: str, column: str = "pixels") -> DataFrame:
    return df.withColumn(column, px.to_dtype(F.col(column), dtype))


def add_ramp(df: DataFrame, shape: tuple[int, int], ramp_x: float, ramp_y: float, offset: float = 0.0, column: str = "pixels") -> DataFrame:
    """Adds ramp_x times the column, ramp_y times the row, and an offset to each pixel."""
    cols = shape[1]
    return df.withColumn(column, F.transform(px.doubles(F.col(column)), lambda v, i: v + (i % cols) * float(ramp_x) + F.floor(i / cols) * float(ramp_y) + float(offset)))


def add_noise(df: DataFrame, shape: tuple[int, int], kind: str = "gaussian", std: float = 1.0, seed: int = 0, key: str = "idx", column: str = "pixels") -> DataFrame:
    """Gaussian noise of a standard deviation, or Poissonian counts with the pixels as means. A pattern's noise depends on
    its key and the seed alone, so that a task that runs again makes the same."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    size = shape[0] * shape[1]
    with_key = df.withColumn("_keyed", F.concat(F.array(F.col(key).cast("double")), px.doubles(F.col(column))))

    def kernel(b: np.ndarray) -> dict[str, np.ndarray]:
        out = np.empty((len(b), size))
        for k, row in enumerate(b):
            rng = np.random.default_rng([seed, int(row[0]) & 0xFFFFFFFF])
            out[k] = row[1:] + rng.normal(0, std, size) if kind == "gaussian" else rng.poisson(np.maximum(row[1:], 0))
        return {column: out}

    return map_patterns(with_key, kernel, StructType([StructField(column, ArrayType(DoubleType()))]), size + 1, "_keyed", drop=["_keyed"])
