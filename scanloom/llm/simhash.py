"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are dealt to ``t // 2 + 1`` blocks. Two fingerprints that differ in at most t bits differ
in at most one bit of some block. In each block the anchors are a covering code of radius 1: Hamming codewords on the
first 15 bits, all values of the others. A fingerprint goes to every anchor within covering radius + 1 = 2, and at its
nearest anchor it is at home. If two differ in one bit of the block at most, each one reaches the other's home. So all
linked pairs meet at an anchor, where they are compared on all 64 bits.

Fingerprints are made distinct first, so a group of equal texts is one point. An anchor with more than ANCHOR_ROWS
points is cut into parts, and each pair of parts is a task of its own. A task sends a spanning forest of the links that
it finds, not its pairs. Components come from min-label propagation over those forests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import LOWER, UPPER, bounded_batches, free_name, join_groups, materialise, small
from scanloom.llm.components import components

#: Points at an anchor before it is cut into parts.
ANCHOR_ROWS = 20_000
SHINGLE, SEED = 4, 42
_UP = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: 4-word shingles with their repeats, XXH64 with seed 42, strict majority for each bit."""
    flat = _SPACE.sub(b" ", text.translate(_UP)).strip(b" ")
    if not flat:
        return 0
    ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(ends) < SHINGLE:
        return xxhash.xxh64_intdigest(flat, SEED)
    starts = [0, *(ends[: len(ends) - SHINGLE + 2] + 1).tolist()]
    stops = [*ends[SHINGLE - 1 :].tolist(), len(flat)]
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the fingerprint as a bigint, and a 64-bit hash of the text, for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t.as_py() or b"") for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, rows.select("doc_id", "text_hash").schema.add("fp", "long"))


def _blocks(t: int) -> list[np.ndarray]:
    """The bits of each block: so many blocks that one of them holds at most one of t differing bits."""
    return np.array_split(np.arange(64, dtype=np.uint64), t // 2 + 1)


def anchors(fp: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): the anchors of each fingerprint of a uint64 array. Anchors of different blocks differ."""
    index, out = [], []
    rows = np.arange(len(fp))
    for k, bits in enumerate(_blocks(t)):
        if len(bits) < 15:
            raise ValueError("so many differing bits leave blocks of under 15 bits")
        # 15 bits as a Hamming codeword and its syndrome; the word for syndrome 0 is the anchor
        word, rest = np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.uint64)
        syndrome = np.zeros(len(fp), np.uint64)
        for j, b in enumerate(bits):
            bit = (fp >> b) & np.uint64(1)
            if j < 15:
                word |= bit << np.uint64(j)
                syndrome ^= bit * np.uint64(j + 1)
            else:
                rest |= bit << np.uint64(j - 15)
        one = np.uint64(1)
        flip = lambda s: np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
        tag = np.uint64(k) << np.uint64(60)
        home = word ^ flip(syndrome)
        at = lambda code, other: tag | (other << np.uint64(15)) | code
        index.append(rows)
        out.append(at(home, rest))
        # codewords at distance 2: flip bit i, then what the new syndrome asks for; each is met twice
        for i in range(1, 16):
            other = syndrome ^ np.uint64(i)
            far = np.flatnonzero((syndrome != i) & (other < i) & (other > 0) & (syndrome > 0))
            index.append(far)
            out.append(at(word[far] ^ (one << np.uint64(i - 1)) ^ flip(other[far]), rest[far]))
        n = len(bits) - 15
        for i in range(n):
            # one bit of the rest: codewords within 1 of the word
            index.append(rows)
            out.append(at(home, rest ^ (one << np.uint64(i))))
        exact = np.flatnonzero(syndrome == 0)
        for i in range(n):
            for j in range(i):
                index.append(exact)
                out.append(at(word[exact], rest[exact] ^ (one << np.uint64(i)) ^ (one << np.uint64(j))))
    return np.concatenate(index), np.concatenate(out)


def forest(fp: np.ndarray, t: int) -> np.ndarray:
    """Links that join all points linked within t bits, directly or through others; as rows of two fingerprints.

    Breadth first: a point that is reached leaves the rest, so that a dense cluster costs little more than its own size.
    """
    rest, links = np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= t
            if near.any():
                found = rest[near]
                links.append(np.stack([np.full(len(found), fp[x]), fp[found]], axis=1))
                queue.extend(found)
                rest = rest[~near]
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def links(points: DataFrame, t: int) -> DataFrame:
    """a, b: links over distinct fingerprints (column fp) with the components of all pairs within t bits."""
    spark = points.sparkSession

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            index, anchor = anchors(fp, t)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[index].view(np.int64))], ["anchor", "fp"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by anchor; an anchor may be spread over several frames
        kept: list[pd.DataFrame] = []
        for f in frames:
            kept.append(f)
            full = pd.concat(kept) if len(kept) > 1 else f
            last = full["key"].iloc[-1] if len(full) else None
            kept = [full[full["key"] == last]]
            yield from joined(full[full["key"] != last])
        if kept:
            yield from joined(kept[0])

    def joined(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, key = f["fp"].to_numpy().view(np.uint64), f["key"].to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1 if len(key) else []
        found = [forest(part, t) for part in np.split(fp, cuts) if len(part) > 1]
        found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
        yield pd.DataFrame({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})

    at = points.select("fp").mapInArrow(placed, "anchor bigint, fp bigint")
    crowded = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ANCHOR_ROWS)
    crowded = materialise(crowded.select(F.col("anchor").alias("hot"), F.ceil(F.col("n") / (ANCHOR_ROWS // 2)).cast("int").alias("parts")), "crowded")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    if crowded.isEmpty():
        keyed = at.select(F.col("anchor").alias("key"), "fp")
    else:
        both = at.join(crowded, at["anchor"] == crowded["hot"], "left")
        calm = both.filter("hot is null").select(F.xxhash64("anchor").alias("key"), "fp")
        hot = both.filter("hot is not null").withColumn("part", part).select("anchor", "fp", F.explode(pairs).alias("pair"))
        keyed = calm.unionByName(hot.select(F.xxhash64("anchor", "pair.i", "pair.j").alias("key"), "fp"))
    sorted_ = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    return sorted_.mapInPandas(compared, "a bigint, b bigint").distinct()


def _classes(docs: DataFrame, t: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and for each distinct one: fp, size (its rows), and first, the first row of its
    component as (whether the id is null, id, hash of the text)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    points = materialise(prints.groupBy("fp").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("size")), "points")
    edges = materialise(links(points, t), "links")
    labels = materialise(components(edges, "fp", "root"), "roots")
    linked = materialise(points.join(labels, "fp"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("points")), "components")
    of = join_groups(linked, least, "root", "points", linked.count()).select("fp", "size", "first")
    return prints, materialise(of.unionByName(points.join(labels, "fp", "left_anti").select("fp", "size", F.col("least").alias("first"))), "classes")


def near_groups(docs: DataFrame, t: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id reachable over links).

    Texts are lower-cased in A-Z and split at ASCII white space. A text of fewer than four words is one shingle; null,
    empty and blank texts have fingerprint zero and link like any other. Fingerprints link at t or fewer differing bits,
    0 included. Rows that repeat an id each get a row. A null id never names a component, unless all of it are null. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    prints, classes = _classes(docs, t, id_col, text_col)
    rows = join_groups(prints, classes, "fp", "size", prints.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, t: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; columns as before.

    Rows go and stay by id and text: of rows with the smallest id and different texts, the one with the least hash of the
    text stays, and of rows that repeat both, one. A null id comes after all others. Null texts count as empty. An empty
    table gives an empty result.
    """
    prints, classes = _classes(docs, t, id_col, text_col)
    rows = join_groups(prints, classes, "fp", "size", prints.count())
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    judged = materialise(rows.select("doc_id", "text_hash", here.alias("stays")), "judged")
    gone_id, gone_hash, own = (free_name(docs, c) for c in ("gone_id", "gone_hash", "own_hash"))
    names = [F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)]
    full = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_hash))
    gone = materialise(judged.filter("not stays").select(*names).distinct(), "gone")
    kept = full.join(small(gone), same, "left_anti")
    again = materialise(judged.filter("stays").groupBy("doc_id", "text_hash").count().filter("count > 1").select(*names), "again")
    if not again.isEmpty():
        again = small(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
