"""Dictionary indexing: the most similar patterns of a dictionary for each pattern of a scan.

The dictionary is prepared once (masked, centred, normalised) and written to the shared folder in packed blocks of bounded
size. The scan isn't shuffled: each task holds a block of its own patterns, streams the dictionary's blocks past it, and
keeps a running top k, with one matrix product per pair of blocks. A dictionary of at most BROADCAST_BYTES, which is
measured after packing, is sent to the tasks instead of being read by each.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from scanloom.kernels.blocks import to_block
from scanloom.storage import bounded_batches, scratch_path

#: Bytes of a packed block of the dictionary, bytes of a block of the scan, and of a dictionary that is broadcast at most.
BLOCK_BYTES, SCAN_BYTES, BROADCAST_BYTES = 16 << 20, 64 << 20, 64 << 20
#: Similarities computed at once.
CELLS = 1 << 23


@dataclass(frozen=True)
class SimilarityMetric:
    """How alike patterns are: ``prepare`` makes rows of patterns comparable, ``match`` compares all rows of two blocks.

    sign is 1 if greater is more similar, -1 otherwise. signal_mask excludes the pixels for which it is true.
    """

    signal_mask: np.ndarray | None = None
    dtype: str = "float64"
    sign: int = field(default=1)

    def __post_init__(self) -> None:
        if self.dtype not in ("float32", "float64"):
            raise ValueError(f"a metric computes in float32 or float64, not {self.dtype}")

    def masked(self, patterns: np.ndarray) -> np.ndarray:
        return patterns if self.signal_mask is None else patterns[:, ~np.asarray(self.signal_mask, bool).ravel()]

    def prepare(self, patterns: np.ndarray) -> np.ndarray:
        return self.masked(patterns)

    def match(self, experimental: np.ndarray, dictionary: np.ndarray) -> np.ndarray:
        return experimental @ dictionary.T


class NormalizedDotProduct(SimilarityMetric):
    """The cosine of the angle between patterns."""

    def prepare(self, patterns: np.ndarray) -> np.ndarray:
        p = self.masked(patterns)
        with np.errstate(invalid="ignore", divide="ignore"):
            return p / np.linalg.norm(p, axis=1, keepdims=True)


class NormalizedCrossCorrelation(SimilarityMetric):
    """The correlation coefficient of patterns."""

    def prepare(self, patterns: np.ndarray) -> np.ndarray:
        p = self.masked(patterns)
        p = p - p.mean(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return p / np.linalg.norm(p, axis=1, keepdims=True)


METRICS = {"ncc": NormalizedCrossCorrelation, "ndp": NormalizedDotProduct}


def metric_of(metric: str | SimilarityMetric, signal_mask: np.ndarray | None, dtype: str) -> SimilarityMetric:
    if isinstance(metric, SimilarityMetric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, it is one of {sorted(METRICS)} or a SimilarityMetric")
    return METRICS[metric](signal_mask, dtype)


def _load(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(raw)) as data:
        return data["index"], data["patterns"]


def pack_dictionary(dictionary: DataFrame, metric: SimilarityMetric, n_pixels: int, index: str = "sim_idx", column: str = "pixels", block_bytes: int = BLOCK_BYTES) -> str:
    """Path of the packed dictionary in the shared folder: a table with ``packed`` and ``n_bytes``, one row per block.
    Null patterns and those of another size aren't in it."""
    bounded_batches(dictionary.sparkSession, max(1, min(1000, block_bytes // (8 * n_pixels))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            out = io.BytesIO()
            np.savez(out, index=np.concatenate([h[0] for h in held]), patterns=np.concatenate([h[1] for h in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary()), pa.array([len(out.getvalue())], pa.int64())], ["packed", "n_bytes"])

        size = 0
        for b in batches:
            block, whole = to_block(b.column(1), n_pixels)
            ready = np.ascontiguousarray(metric.prepare(block), metric.dtype)
            ids = b.column(0).to_numpy(zero_copy_only=False)[whole].astype(np.int64)
            fine = np.isfinite(ready).all(axis=1)
            held.append((ids[fine], ready[fine]))
            size += ready.nbytes
            if size >= block_bytes:
                yield flush()
                size = 0
        if held:
            yield flush()

    path = scratch_path(dictionary.sparkSession, "dictionary")
    rows = dictionary.select(F.col(index).cast("bigint"), F.col(column))
    rows.mapInArrow(packed, "packed binary, n_bytes bigint").write.option("compression", "none").parquet(path)
    return path


def _blocks_of(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    fs, at = pafs.FileSystem.from_uri(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1, columns=["packed"]):
                    yield _load(batch.column(0)[0].as_py())


def best_of(scores: np.ndarray, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row with their indices, ties by the smaller index. index: (m,) or as the scores."""
    n, m = scores.shape
    index = np.broadcast_to(index, scores.shape)
    if m > k:
        part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(scores, part, axis=1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((scores >= least).sum(axis=1) > k)
        for r in tied:  # which of several equal scores belong depends on their indices
            part[r] = np.lexsort((index[r], -scores[r]))[:k]
        scores, index = np.take_along_axis(scores, part, axis=1), np.take_along_axis(index, part, axis=1)
    order = np.lexsort((index, -scores), axis=1)
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(index, order, axis=1)


def _search(ready: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], metric: SimilarityMetric, k: int) -> tuple[np.ndarray, np.ndarray]:
    best, which = np.zeros((len(ready), 0)), np.zeros((len(ready), 0), np.int64)
    for index, patterns in blocks:
        if not len(index) or not len(ready):
            continue
        step = max(1, CELLS // len(index))
        found = [best_of(metric.sign * metric.match(ready[a : a + step], patterns), index, k) for a in range(0, len(ready), step)]
        best = np.concatenate([best, np.concatenate([f[0] for f in found])], axis=1)
        which = np.concatenate([which, np.concatenate([f[1] for f in found])], axis=1)
        best, which = best_of(best, which, k)
    return metric.sign * best, which


def dictionary_indexing(experimental: DataFrame, dictionary: DataFrame, n_pixels: int, metric: str | SimilarityMetric = "ncc", keep_n: int = 20, navigation_mask: Column | None = None, signal_mask: np.ndarray | None = None, dtype: str = "float64", rotations: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES, column: str = "pixels", index: str = "sim_idx") -> DataFrame:
    """The columns of ``experimental`` without the patterns, ``scores`` and ``simulation_indices`` (the best ``keep_n``,
    best first, ties by the smaller index).

    ``dictionary`` has ``sim_idx`` and patterns. Points for which ``navigation_mask`` is true are left out. Null and
    constant patterns get nulls. With ``rotations`` (sim_idx, a, b, c, d) the best match's rotation is added as a struct.
    """
    metric = metric_of(metric, signal_mask, dtype)
    spark = experimental.sparkSession
    path = pack_dictionary(dictionary, metric, n_pixels, index, column)
    total = spark.read.parquet(path).agg(F.sum("n_bytes")).first()[0] or 0
    if total <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([bytes(r[0]) for r in spark.read.parquet(path).select("packed").collect()])
        blocks: Callable[[], Iterator] = lambda: map(_load, sent.value)
    else:
        blocks = lambda: _blocks_of(path)
    source = experimental if navigation_mask is None else experimental.filter(~navigation_mask)
    kept = [f for f in source.schema if f.name != column]
    schema = StructType([*kept, StructField("scores", ArrayType(DoubleType())), StructField("simulation_indices", ArrayType(LongType()))])
    bounded_batches(spark, max(1, min(1000, (16 << 20) // (8 * n_pixels))))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ready = np.concatenate([h[1] for h in held])
            scores, which = _search(ready, blocks(), metric, keep_n)
            at = 0
            for batch, own, fine in held:
                ends = np.concatenate([[0], np.cumsum(np.where(fine, scores.shape[1], 0))]).astype(np.int32)
                rows = slice(at, at + len(own))
                at += len(own)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[rows].ravel().astype(t)), mask=pa.array(~fine)) for v, t in ((scores, np.float64), (which, np.int64))]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *lists], [f.name for f in schema])
            held.clear()

        size = 0
        for batch in batches:
            block, whole = to_block(batch.column(column), n_pixels)
            ready = np.asarray(metric.prepare(block), metric.dtype)
            good = np.isfinite(ready).all(axis=1)
            fine = whole.copy()
            fine[whole] = good
            held.append((batch, ready[good], fine))
            size += ready.nbytes
            if size >= SCAN_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    out = source.mapInArrow(searched, schema)
    if rotations is None:
        return out
    # the lookup is an ordinary equi-join: Spark broadcasts the rotations if they are small
    names = rotations.select(F.col(index).alias("_best"), F.struct("a", "b", "c", "d").alias("rotation"))
    return out.withColumn("_first", F.get("simulation_indices", F.lit(0))).join(names, F.col("_first") == F.col("_best"), "left").drop("_first", "_best")


def ranked_matches(matches: DataFrame, *keys: str) -> DataFrame:
    """One row per match: the keys, rank (from 1), sim_idx, score."""
    both = F.arrays_zip(F.col("simulation_indices").alias("i"), F.col("scores").alias("s"))
    return matches.select(*keys, F.posexplode(both).alias("pos", "m")).select(*keys, (F.col("pos") + 1).alias("rank"), F.col("m.i").alias("sim_idx"), F.col("m.s").alias("score"))
