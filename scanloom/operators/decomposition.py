"""Principal components of patterns, from the matrix of pixel products.

Each task adds up the products of its own patterns and sends them in row blocks; blocks are summed by tasks of their own,
and only the sum, pixels x pixels, comes to the driver. So the patterns are read twice and never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from scanloom.kernels.blocks import doubles, map_patterns, to_block
from scanloom.storage import bounded_batches

#: Rows of the product matrix in a block, and pixels of a pattern at most (the matrix has 8 bytes for each pair).
BLOCK, MOST_PIXELS = 64, 8192


def product_matrix(df: DataFrame, n_pixels: int, column: str = "pixels") -> np.ndarray:
    """Sums over all patterns of the products of pixels i and j. Null patterns don't count."""
    if n_pixels > MOST_PIXELS:
        raise ValueError(f"patterns of {n_pixels} pixels are too large to decompose, bin them to {MOST_PIXELS} or fewer")
    bounded_batches(df.sparkSession, max(1, min(1000, (16 << 20) // (8 * n_pixels))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            block, _ = to_block(b.column(0), n_pixels)
            if len(block):
                total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            for k in range(0, n_pixels, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], ["at", "block"])

    def joined(batches: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in batches.column("block"))
        return pa.table({"at": [batches.column("at")[0].as_py()], "block": [total.tobytes()]}, schema=pa.schema([("at", pa.int32()), ("block", pa.binary())]))

    parts = df.select(column).mapInArrow(summed, "at int, block binary").groupBy("at").applyInArrow(joined, "at int, block binary").collect()
    out = np.zeros((n_pixels, n_pixels))
    for at, block in parts:
        out[at : at + BLOCK] = np.frombuffer(block).reshape(-1, n_pixels)
    return out


def factors(df: DataFrame, n_pixels: int, n_components: int | None = None, column: str = "pixels") -> tuple[np.ndarray, np.ndarray]:
    """(factors (pixels, m), variance along each), greatest first. Signs are fixed by each factor's largest element."""
    values, vectors = np.linalg.eigh(product_matrix(df, n_pixels, column))
    order = np.argsort(-values)[:n_components]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs), np.maximum(values[order], 0)


def loadings(df: DataFrame, found: np.ndarray, column: str = "pixels") -> DataFrame:
    """``df`` without the patterns, with ``loadings``: each pattern along each factor."""
    schema = StructType([StructField("loadings", ArrayType(DoubleType()))])
    return map_patterns(df, lambda b: {"loadings": b @ found}, schema, len(found), column).drop(column)


def decomposition_model(df: DataFrame, n_pixels: int, components: int | Sequence[int] | None = None, found: np.ndarray | None = None, column: str = "pixels") -> DataFrame:
    """Patterns rebuilt from all components, the first so many, or a list of them."""
    found = factors(df, n_pixels, column=column)[0] if found is None else found
    if components is not None:
        found = found[:, :components] if isinstance(components, int) else found[:, list(components)]
    return map_patterns(df, lambda b: {column: (b @ found) @ found.T}, doubles(column), n_pixels, column)
