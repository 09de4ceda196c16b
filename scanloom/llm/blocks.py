"""Documents in compressed files of bounded size in the shared folder, so that later passes read them by reference."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import bounded_batches, materialise, scratch_path

#: Bytes of text in a block; a longer text has a block of its own.
BLOCK_BYTES = 8 << 20


class Block:
    """ids (null: the least integer), a hash of each text, and the texts' bytes with where each begins and ends."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, raw: bytes):
        self.ids, self.null, self.hashes, self.raw = ids, null, hashes, raw
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes

    @staticmethod
    def load(path: str) -> Block:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at) as file:
            data = zstandard.ZstdDecompressor().decompress(file.read())
        (n,) = struct.unpack_from("<Q", data)
        ids, hashes, sizes = (np.frombuffer(data, np.int64, n, 8 + 8 * n * k) for k in range(3))
        null = np.frombuffer(data, np.uint8, n, 8 + 24 * n).astype(bool)
        return Block(ids, null, hashes.view(np.uint64), sizes, data[8 + 25 * n :])


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, path, n_docs, n_bytes: one row per file. The table is written too, so a task that runs again later can't
    change it; what such a task leaves behind isn't listed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, "blocks")
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4()
            null = np.array([i is None for i in ids], np.uint8)
            columns = [np.array([-(1 << 63) if i is None else i for i in ids], np.int64), np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64), np.array([len(t) for t in texts], np.int64)]
            data = struct.pack("<Q", len(ids)) + b"".join(c.tobytes() for c in columns) + null.tobytes() + b"".join(texts)
            path = f"{folder}/{name.hex}"
            store, where = pafs.FileSystem.from_uri(path)
            store.create_dir(os.path.dirname(where))
            with store.open_output_stream(where) as file:
                file.write(zstandard.ZstdCompressor(level=1).compress(data))
            row = [[name.int >> 65], [path], [len(ids)], [sum(map(len, texts))]]
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["block", "path", "n_docs", "n_bytes"])

        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or b""
                if ids and size + len(text) > BLOCK_BYTES:
                    yield flush()
                    size = 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialise(rows.mapInArrow(written, "block bigint, path string, n_docs bigint, n_bytes bigint"), "manifest")
