"""Benchmark decontamination over a distributed positional inverted index.

The index is a table with one row per block of documents: the sorted distinct terms (64-bit hashes), where the postings
of each begin, and the postings, ascending positions in the block. Blocks are bounded in words, so a very common term
has a bounded list in each, and no posting shuffles: a query goes to the blocks. It is built once, kept in the shared
folder, and serves any benchmark.

A benchmark item is a set of windows of consecutive words. In each block, windows with a term that the block lacks drop
out. For the others the postings of the rarest term are the candidates, and the lists of the other terms, from rare to
common, are intersected with them after adjusting for their offsets. With ``slop`` each term may be so many positions
away from its place, in any order, which gives proximity matches.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from scanloom.llm.arrays import LOW_BYTES, WORD_BYTES, hash_runs, runs
from scanloom.llm.common import bounded_batches, free_name, materialise, scratch_path, small

#: Words of a window and of a block, bytes tokenised at once, bytes of benchmark text in a pack, candidates at once.
WINDOW, BLOCK_WORDS, CHUNK, PACK_BYTES, AT_ONCE = 10, 1 << 20, 1 << 20, 8 << 20, 1 << 20


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each has. Words are lower-cased in A-Z."""
    raw = LOW_BYTES[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    first, last = runs(WORD_BYTES[raw])
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    return hash_runs(raw, first, last), np.diff(upto, prepend=0)


@dataclass
class Block:
    """Postings of some documents. Between documents one position is left free, so that no phrase runs across."""

    terms: np.ndarray
    starts: np.ndarray
    postings: np.ndarray
    n_words: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, n_words: np.ndarray) -> Block:
        doc = np.repeat(np.arange(len(n_words)), n_words)
        position = np.arange(len(hashes)) + doc
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return Block(ordered[starts], np.append(starts, len(ordered)), position[order].astype(np.int64), n_words)

    def bases(self) -> np.ndarray:
        """The position of each document's first word, and one for the end."""
        return np.concatenate([[0], np.cumsum(self.n_words + 1)])


@dataclass
class Queries:
    """Windows of one length: a row of terms each, and the item it belongs to."""

    windows: np.ndarray
    item: np.ndarray


def find(block: Block, queries: Queries, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(query, position): where each window of ``queries`` begins in the block, less ``slop`` if terms may stray."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.terms) or not len(queries.windows):
        return none
    rank = np.searchsorted(block.terms, queries.windows)
    there = (block.terms[np.minimum(rank, len(block.terms) - 1)] == queries.windows).all(axis=1)
    query = np.flatnonzero(there)
    if not len(query):
        return none
    rank = rank[query]
    size = block.starts[rank + 1] - block.starts[rank]
    order = np.argsort(size, axis=1, kind="stable")  # from the rarest term of a window on
    bases = block.bases()
    shift = np.int64(bases[-1] + 1 + 2 * slop + queries.windows.shape[1])
    keys = np.repeat(np.arange(len(block.terms)), np.diff(block.starts)) * shift + block.postings
    doc_at = np.repeat(np.arange(len(block.n_words)), block.n_words + 1)
    rows = np.arange(len(query))
    rare = size[rows, order[:, 0]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = np.searchsorted(np.cumsum(rare), np.arange(AT_ONCE, rare.sum() + AT_ONCE, AT_ONCE))
    for part in np.split(rows, np.unique(np.minimum(cuts + 1, len(rows)))):
        if not len(part):
            continue
        own, n = order[part, 0], rare[part]
        begin = block.starts[rank[part, own]]
        row = np.repeat(part, n)
        at = block.postings[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        start = at - np.repeat(own, n)
        for k in range(1, order.shape[1]):
            j = order[row, k]
            # terms that stray don't stray into the document before
            low = rank[row, j] * shift + np.maximum(start + j - slop, bases[doc_at[at]] if slop else 0)
            hit = np.searchsorted(keys, low)
            ok = (start + j + slop >= 0) & (hit < len(keys))
            ok &= keys[np.minimum(hit, len(keys) - 1)] <= rank[row, j] * shift + np.maximum(start + j + slop, -1)
            if slop:
                other = np.minimum(keys[np.minimum(hit, len(keys) - 1)] % shift, len(doc_at) - 1)
                ok &= doc_at[other] == doc_at[at]
            row, start, at = row[ok], start[ok], at[ok]
        found.append((query[row], start))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder: ids, text_hashes, n_words, terms, starts, postings for each block.

    Every row of ``docs`` is in exactly one block. Null texts have no words. A text is never split over blocks.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    ids = ArrayType(rows.schema["doc_id"].dataType)
    schema = StructType([StructField("ids", ids), StructField("text_hashes", ArrayType(LongType())), StructField("n_words", ArrayType(IntegerType())), StructField("terms", BinaryType()), StructField("starts", BinaryType()), StructField("postings", BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray, np.ndarray, list]] = []

        def flush() -> pa.RecordBatch:
            b = Block.of(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            keys, texts = [x for h in held for x in h[0]], [x for h in held for x in h[3]]
            held.clear()
            data = [pa.array([keys], pa.list_(kind)), pa.array([texts], pa.list_(pa.int64())), pa.array([b.n_words.tolist()], pa.list_(pa.int32()))]
            data += [pa.array([x.tobytes()], pa.binary()) for x in (b.terms, b.starts.astype(np.uint32), b.postings.astype(np.uint32))]
            return pa.RecordBatch.from_arrays(data, schema.names)

        kind = pa.int64()
        for batch in batches:
            kind, at = batch.column(0).type, 0
            keys, text_hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t.as_py() or b"" for t in batch.column(1)]
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
                    size += len(texts[to])
                    to += 1
                hashes, n = terms(texts[at:to])
                held.append((keys[at:to], hashes, n, text_hashes[at:to]))
                at = to
                if sum(len(h[1]) for h in held) >= BLOCK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return materialise(rows.mapInArrow(blocks, schema), "postings")


def pack_benchmark(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Files in the shared folder with the windows of all items, PACK_BYTES of text in each, made while rows stream by.

    An item of fewer words than a window, but not none, is one window. A null id is an item named "".
    """
    spark, packs = benchmark.sparkSession, []
    held: list[tuple[str, bytes]] = []

    def flush() -> None:
        hashes, n = terms([t for _, t in held])
        upto = np.cumsum(n)
        data = {"items": np.array([i for i, _ in held], dtype=str)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, words in enumerate(np.split(hashes, upto[:-1])):
            if len(words):
                view = np.lib.stride_tricks.sliding_window_view(words, min(window, len(words)))
                by_length.setdefault(view.shape[1], []).append((k, view))
        for length, found in by_length.items():
            pairs = np.unique(np.concatenate([np.column_stack([np.full(len(v), k, np.uint64), v]) for k, v in found]), axis=0)
            data[f"w{length}"] = pairs
        path = scratch_path(spark, "benchmark")
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(at))
        out = io.BytesIO()
        np.savez(out, **data)
        with fs.open_output_stream(at) as file:
            file.write(out.getvalue())
        packs.append(path)
        held.clear()

    size = 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        held.append((row[0], row[1].encode()))
        size += len(held[-1][1])
        if size >= PACK_BYTES:
            flush()
            size = 0
    if held:
        flush()
    return packs


def _load(path: str) -> tuple[np.ndarray, list[Queries]]:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as file:
        data = np.load(io.BytesIO(file.read()))
    return data["items"], [Queries(data[k][:, 1:], data[k][:, 0].astype(np.int64)) for k in data.files if k != "items"]


def matches(index: DataFrame, packs: list[str], slop: int = 0) -> DataFrame:
    """One row per document of the index: doc_id, n_words, n_hit, items (sorted as strings), spans of hit words, text_hash."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [_load(packs[0])] if len(packs) == 1 else None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n = batch.column("ids")[r].values, batch.column("n_words")[r].values.to_numpy()
                arrays = [np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("terms", np.uint64), ("starts", np.uint32), ("postings", np.uint32))]
                block = Block(arrays[0], arrays[1].astype(np.int64), arrays[2].astype(np.int64), n)
                bases = block.bases()
                cover = np.zeros(bases[-1] + 1, np.int64)
                items: list[set[str]] = [set() for _ in n]
                for names, groups in loaded or map(_load, packs):
                    for q in groups:
                        which, start = find(block, q, slop)
                        length = q.windows.shape[1]
                        doc = np.searchsorted(bases, start + (length // 2 if slop else 0), "right") - 1
                        doc = np.clip(doc, 0, max(0, len(n) - 1))
                        low, high = np.maximum(start - slop, bases[doc]), np.minimum(start + length + slop, bases[doc] + n[doc])
                        np.add.at(cover, low, 1)
                        np.add.at(cover, high, -1)
                        for d, i in np.unique(np.column_stack([doc, q.item[which]]), axis=0):
                            items[d].add(str(names[i]))
                hit = np.cumsum(cover[:-1]) > 0
                first, last = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) == 1), np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) == -1)
                total = np.concatenate([[0], np.cumsum(hit)])
                of = np.searchsorted(bases, first, "right") - 1
                cuts = np.searchsorted(of, np.arange(len(n) + 1))
                spans = [[{"start": int(first[k] - bases[d]), "stop": int(last[k] - bases[d])} for k in range(cuts[d], cuts[d + 1])] for d in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n.astype(np.int64)), pa.array(total[bases[1:]] - total[bases[:-1]], pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(spans, pa.list_(span)), batch.column("text_hashes")[r].values],
                    ["doc_id", "n_words", "n_hit", "items", "spans", "text_hash"],
                )

    return index.mapInArrow(searched, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>, text_hash bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items, spans, text_hash (XXH64 of the text).

    A word is hit if it lies in an occurrence of any window of any item. items are the ids of items with windows that
    occur, sorted as strings. Null and empty texts have no words and hit nothing; an empty benchmark hits nothing; an
    empty table gives an empty result. Rows that repeat an id are each looked at. Other columns are ignored.
    """
    return matches(build_index(docs), pack_benchmark(benchmark, window), slop)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a benchmark window occurs in; columns as before.

    Rows go by id and text, so that of rows with the same id, or none, those stay that have clean texts. Null and empty
    texts have no words and stay; so does every row if the benchmark is empty. An empty table gives an empty result.
    """
    hit_id, hit_hash = free_name(docs, "hit_id"), free_name(docs, "hit_hash")
    hit = matches(build_index(docs, id_col, text_col), pack_benchmark(benchmark, window)).filter("n_hit > 0")
    hit = materialise(hit.select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)).distinct(), "hit")
    return docs.join(small(hit), F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.col(text_col)) == F.col(hit_hash)), "left_anti")
