"""Arrow batches of patterns as NumPy blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

from scanloom.storage import bounded_batches

Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]


def to_block(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, whole): the patterns as rows of doubles, and which rows of the column they are. Null patterns and those of
    another size aren't in the block."""
    lengths = np.asarray(column.value_lengths().fill_null(-1)) if len(column) else np.zeros(0, int)
    whole = lengths == size
    if not whole.all():
        column = column.filter(pa.array(whole))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(-1, size), whole


def from_block(values: np.ndarray, whole: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column with null where there was no pattern. Rows of a 2-D array become lists; NaN becomes null."""
    n = len(whole)
    if values.ndim == 1:
        out = np.zeros(n, values.dtype)
        out[whole] = values
        bad = ~whole
        if values.dtype.kind == "f":
            bad = bad | np.isnan(out)
        return pa.array(out, mask=bad).cast(kind)
    bad = ~whole
    if values.dtype.kind == "f":
        broken = np.isnan(values).all(axis=1)
        keep = np.flatnonzero(whole)
        bad = bad.copy()
        bad[keep[broken]] = True
        values = values[~broken]
    offsets = np.concatenate([[0], np.cumsum(np.where(bad, 0, values.shape[1]))]).astype(np.int32)
    flat = values.ravel()
    flat = pa.array(flat, mask=np.isnan(flat)) if flat.dtype.kind == "f" else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.cast(kind.value_type), mask=pa.array(bad))


def map_patterns(df: DataFrame, kernel: Kernel, out: StructType, size: int, column: str = "pixels", drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of ``out``, made by ``kernel`` from blocks of patterns; a column that exists is replaced.

    Nothing shuffles, and only a batch is held at a time. Null patterns, and those that don't have ``size`` pixels, give null.
    """
    bounded_batches(df.sparkSession, max(1, min(1000, (32 << 20) // (8 * size))))
    names = {f.name for f in out}
    kept = [f for f in df.schema if f.name not in names and f.name not in drop]
    schema = StructType([*kept, *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            block, whole = to_block(batch.column(column), size)
            columns = [batch.column(f.name) for f in kept]
            if not len(block):
                columns += [pa.nulls(len(whole), to_arrow_type(f.dataType)) for f in out]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])
                continue
            made = kernel(block)
            columns += [from_block(np.asarray(made[f.name]), whole, to_arrow_type(f.dataType)) for f in out]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return df.mapInArrow(run, schema)


def doubles(name: str = "pixels") -> StructType:
    from pyspark.sql.types import ArrayType, StructField

    return StructType([StructField(name, ArrayType(DoubleType()))])


def double(name: str) -> StructType:
    from pyspark.sql.types import StructField

    return StructType([StructField(name, DoubleType())])
