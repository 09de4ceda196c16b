"""Repeated substrings over a sparse suffix array.

A suffix for each byte doesn't fit (100 bytes to sort for each byte of text), so suffixes are sampled at anchors: in each
window of LENGTH bytes the leftmost KGRAM-gram with the least hash. Equal windows have their anchors at equal offsets, so
if a window repeats, two anchor suffixes share at least KGRAM bytes. Windows that equal one a short period earlier in the
same text are known to repeat and need no anchor; without that, runs of one word would be all anchors.

1. An anchor's suffix is three tokens: its first eight bytes, a hash of its k-gram, and a hash of all bytes that its
   windows can reach (the context). Of equal suffixes in a block only the first travels. Suffixes are dealt to buckets by
   their leading tokens, between splitters from a sample of them, and a bucket sorts its own by multikey sort. All
   occurrences of a context but the first are then repeats in whole. First occurrences of contexts that share a k-gram
   with another context go on. The last k-gram of a bucket may go on in the next one, which is where buckets are compared
   over their boundary: contexts with such a k-gram always go on.
2. Those suffixes are dealt to buckets by their leading bytes, between splitters from a sample of them. A bucket sorts
   them by multikey sort, and the left contexts, reversed, in the same way. For each offset of a window in its context,
   equal windows are a range of suffixes that agree to the right and a range that agree to the left; of each such pair of
   ranges the first occurrence stays. Splitters never part equal leading bytes and k-grams are longer than those, so the
   comparison over a boundary finds no two suffixes with a common anchor. Leading bytes that two or more splitters have in
   common belong to a passage in very many documents, and no bucket gets all of those: their windows are dealt one by one,
   by a hash of all their bytes, and of equal windows in a block only the first travels.
3. The bytes of all repeated windows are counted and cut, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.arrays import mix
from scanloom.llm.blocks import Block, write_blocks
from scanloom.llm.common import materialise

LENGTH, KGRAM = 100, 32
SPAN = LENGTH - KGRAM + 1
#: Bytes worked on at once, and their bits; anchors in a bucket of step 1 and suffixes in one of step 2, about.
PIECE, BITS, BUCKET, SORTED = 1 << 19, 24, 1 << 18, 1 << 16
#: Sampled suffixes for each bucket, at least and at most; blocks that they are taken from at most, and bytes of
#: texts at the start of each.
PER_BUCKET, LEAST_SAMPLE, MOST_SAMPLE, SAMPLED_BLOCKS, SAMPLED_BYTES = 50, 20_000, 2_000_000, 1000, 1 << 20
_BYTE = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64((1 << BITS) - 1)


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and what makes a difference of them independent of its place."""
    powers = []
    for base in (_ODD, _INVERSE):
        p = np.full(len(raw) + 1, base)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers[0][:-1], out=sums[1:])
    return sums, powers[1]


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    out, m = key, 1
    while 2 * m <= span:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    return np.minimum(out[: len(out) - (span - m)], out[span - m :]) if m < span else out


def _periodic(text: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """True for each window start whose window equals the one a period earlier."""
    out = np.zeros(max(0, len(text) - LENGTH + 1), bool)
    for q in periods:
        if len(text) >= LENGTH + q:
            wrong = np.concatenate([[0], np.cumsum(text[q:] != text[:-q], dtype=np.int32)])
            out[q:] |= wrong[LENGTH:] == wrong[:-LENGTH]
    return out


def anchors(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, position, k-gram hash, context hash) of the anchors of texts raw[first:last], and (doc, start, stop) of the
    runs of bytes in windows that repeat at a short period. Positions count from a text's first byte."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    repeats: list[tuple[int, int, int]] = []
    # pieces: a run of whole short texts, or a part of a long one with what its windows and contexts need around it
    k = 0
    while k < len(first):
        to = k + 1
        if last[k] - first[k] <= PIECE:
            while to < len(first) and last[to] - first[k] <= PIECE:
                to += 1
            _piece(raw[first[k] : last[to - 1]], np.arange(k, to), first[k:to] - first[k], last[k:to] - first[k], 0, None, found, repeats)
        else:
            n = last[k] - first[k]
            for at in range(0, n - LENGTH + 1, PIECE):
                low, high = max(0, at - SPAN), min(n, at + PIECE + 2 * LENGTH)
                _piece(raw[first[k] + low : first[k] + high], np.array([k]), np.array([0]), np.array([high - low]), low, (at - low, at - low + PIECE), found, repeats)
        k = to
    empty = np.zeros(0, np.int64)
    out = [np.concatenate(x) if x else empty for x in found]
    if len(out[0]):  # neighbouring pieces may share an anchor
        _, only = np.unique(out[0].astype(np.uint64) << np.uint64(40) | out[1].astype(np.uint64), return_index=True)
        out = [x[only] for x in out]
    return *out, np.array(repeats, np.int64).reshape(-1, 3)


def _piece(raw, docs, first, last, base, within, found, repeats) -> None:
    if len(raw) < LENGTH:
        return
    sums, back = _sums(raw)
    gram = mix((sums[KGRAM:] - sums[:-KGRAM]) * back[: len(raw) - KGRAM + 1])
    key = (gram >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(gram), dtype=np.uint64)
    least = (_least(key, SPAN) & _LOW).astype(np.int64)
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(docs)), last - first)
    valid = start + LENGTH <= last[doc[: len(least)]]
    if within:
        valid &= (start >= within[0]) & (start < within[1])
    at = np.unique(least[valid])
    # the same k-gram twice within a span: a short period may begin
    near = (gram[at[1:]] == gram[at[:-1]]) & (at[1:] - at[:-1] <= SPAN) & (doc[at[1:]] == doc[at[:-1]])
    if near.any():
        for d in np.unique(doc[at[1:]][near]):
            periods = np.unique((at[1:] - at[:-1])[near & (doc[at[1:]] == d)])
            again = _periodic(raw[first[d] : last[d]], periods)
            again &= valid[first[d] : first[d] + len(again)]
            valid[first[d] : first[d] + len(again)] &= ~again
            edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            repeats += [(int(docs[d]), int(a + base), int(b - 1 + LENGTH + base)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        at = np.unique(least[valid])
    d = doc[at]
    left, right = np.minimum(SPAN - 1, at - first[d]), np.minimum(LENGTH, last[d] - at)
    context = mix((sums[at + right] - sums[at - left]) * back[at - left] + (left * 1000 + right).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for x, y in zip(found, (docs[d], at - first[d] + base, gram[at], context), strict=True):
        x.append(y)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _group_value(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value at the first row of each row's group."""
    return values[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]


_TOKENS = np.dtype([("lead", "<u8"), ("gram", "<u8"), ("context", "<u8")])
_STEP1 = np.dtype([("lead", "<u8"), ("gram", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("id", "<i8"), ("hash", "<u4")])
_AT = np.dtype([("doc", "<u4"), ("at", "<u4")])
_COVER = np.dtype([("doc", "<u4"), ("start", "<u4"), ("stop", "<u4")])
_STEP2 = np.dtype([("doc", "<u4"), ("at", "<u4"), ("id", "<i8"), ("hash", "<u4"), ("left", "u1"), ("right", "u1"), ("before", "u1", SPAN - 1), ("after", "u1", LENGTH)])


def _pack(rows: np.ndarray, transpose: bool) -> bytes:
    """Rows compressed; transposed, all first bytes come first, then all second ones: sorted and small numbers shrink."""
    raw = rows.view(np.uint8).reshape(len(rows), -1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T if transpose else raw).tobytes())


def _unpack(packed: list[bytes], kind: np.dtype, transposed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all packs, and the number of rows of each."""
    parts = []
    for p in packed:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(p) if p else b"", np.uint8)
        raw = raw.reshape(kind.itemsize, -1).T if transposed else raw.reshape(-1, kind.itemsize)
        parts.append(np.ascontiguousarray(raw).reshape(-1).view(kind))
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(x) for x in parts], np.int64)


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], list(kinds))


_KINDS1 = {"bucket": pa.int64(), "block": pa.int64(), "sent": pa.binary(), "cover": pa.binary(), "whole": pa.binary()}
_KINDS_FOUND = {"block": pa.int64(), "cover": pa.binary(), "whole": pa.binary(), "more": pa.binary()}


def _lead(b: Block, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at places of documents, in the order of bytes; a k-gram stands there, so they are all there."""
    raw = np.frombuffer(b.raw, np.uint8)
    if not len(doc):
        return np.zeros(0, np.uint64)
    return raw[(b.first[doc] + at)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def _order(tokens: dict[str, np.ndarray] | np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of suffixes by their tokens; equal ones in the order of ``first``, the least important key first."""
    by = np.lexsort(first) if first else np.arange(len(tokens["gram"]))
    words = np.stack([np.asarray(tokens[k])[by] for k in ("lead", "gram", "context")], axis=1).astype(">u8")
    return by[multikey_order(np.ascontiguousarray(words).view(np.uint8).reshape(len(by), 24))]


def _bucket_of(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The bucket of each row, by how many splitters aren't behind it."""
    both = {k: np.concatenate([splitters[k], rows[k]]) for k in _TOKENS.names}
    is_row = np.arange(len(splitters) + len(rows)) >= len(splitters)
    order = _order(both, is_row)
    passed = np.cumsum(~is_row[order])
    out = np.empty(len(rows), np.int64)
    out[order[is_row[order]] - len(splitters)] = passed[is_row[order]]
    return out


def _place(b: Block) -> np.ndarray:
    """The place of each document in the order of ids; those equal in id and text are one document."""
    hashes = b.hashes >> np.uint64(32)
    order = np.lexsort((hashes, b.ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(_firsts(b.ids[order], hashes[order]))
    return place


def _step1(b: Block, doc: np.ndarray, at: np.ndarray, lead: np.ndarray, gram: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that travel, in the order of their tokens; places of the others): of equal suffixes of a block the first one."""
    when = _place(b)[doc] << 32 | at
    by = _order({"lead": lead, "gram": gram, "context": context}, when)
    same = _group_value(_firsts(gram[by], context[by]), when[by]) == when[by]
    go, stay = by[same], by[~same]
    rest = np.zeros(len(stay), _AT)
    rest["doc"], rest["at"] = doc[stay], at[stay]
    rows = np.zeros(len(go), _STEP1)
    for k, v in (("lead", lead), ("gram", gram), ("context", context), ("doc", doc), ("at", at)):
        rows[k] = v[go]
    rows["id"], rows["hash"] = b.ids[doc[go]], b.hashes[doc[go]] >> np.uint64(32)
    return rows, rest


def _packs(name: int, rows: np.ndarray, bucket: np.ndarray, cover: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    parts = [(int(bucket[p[0]]), _pack(rows[p], True)) for p in np.split(by, cuts) if len(p)]
    # what needs no bucket goes along with any
    parts = parts or [(0, b"")]
    n = len(parts)
    return _rows({"bucket": [p[0] for p in parts], "block": [name] * n, "sent": [p[1] for p in parts], "cover": [cover.tobytes()] + [b""] * (n - 1), "whole": [whole.tobytes()] + [b""] * (n - 1)}, _KINDS1)


def _send_anchors(splitters: np.ndarray):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist(), strict=True):
                b = Block.load(path)
                doc, at, gram, context, repeats = anchors(np.frombuffer(b.raw, np.uint8), b.first, b.last)
                cover = np.zeros(len(repeats), _COVER)
                cover["doc"], cover["start"], cover["stop"] = repeats.T
                rows, whole = _step1(b, doc, at, _lead(b, doc, at), gram, context)
                yield _packs(name, rows, _bucket_of(rows, splitters), cover, whole)

    return sent


def _sample_anchors(per_block: int):
    """Tokens of some suffixes of each block."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                b = Block.load(path)
                raw = b.raw[: int(b.last[np.searchsorted(b.last, SAMPLED_BYTES)]) if b.last[-1] > SAMPLED_BYTES else len(b.raw)] if len(b.last) else b""
                n = int(np.searchsorted(b.last, len(raw), "right"))
                doc, at, gram, context, _ = anchors(np.frombuffer(raw, np.uint8), b.first[:n], b.last[:n])
                rows, _ = _step1(b, doc, at, _lead(b, doc, at), gram, context)
                some = rows[np.random.default_rng(len(rows)).permutation(len(rows))[:per_block]]
                yield pa.RecordBatch.from_arrays([pa.array(some[k].view(np.int64)) for k in _TOKENS.names], list(_TOKENS.names))

    return sampled


def _matched(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Blocks of a bucket's packs; its rows, sorted; where a suffix differs from the one before; whether a row is the first
    of its suffix; and the rows of each pack."""
    names, sent = table.column("block").to_pylist(), table.column("sent").to_pylist()
    rows, sizes = _unpack(sent, _STEP1, True)
    block = np.repeat(np.arange(len(names)), sizes)
    by = _order(rows, rows["at"], rows["hash"], rows["id"])
    r, block = rows[by], block[by]
    new = _firsts(r["gram"], r["context"])
    first = np.ones(len(r), bool)
    for k in ("id", "hash", "at"):
        first &= _group_value(new, r[k]) == r[k]
    by = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[by], np.arange(len(names) + 1))
    return names, r, new, first, [by[cuts[k] : cuts[k + 1]] for k in range(len(names))]


def _match_contexts(edges: np.ndarray):
    """Step 1 in a bucket. ``edges``: k-grams of the splitters, which may be in two buckets."""

    def matched(table: pa.Table) -> pa.Table:
        names, r, new, first, packs = _matched(table)
        group = np.cumsum(_firsts(r["gram"])) - 1
        several = (np.bincount(group, new, 1)[group] > 1 if len(group) else first) | np.isin(r["gram"], edges)
        out = {"block": names, "cover": table.column("cover").to_pylist(), "whole": [], "more": []}
        at = np.zeros(len(r), _AT)
        at["doc"], at["at"] = r["doc"], r["at"]
        for own, had in zip(packs, table.column("whole").to_pylist(), strict=True):
            out["whole"].append(had + at[own[~first[own]]].tobytes())
            out["more"].append(at[own[(first & several)[own]]].tobytes())
        return pa.Table.from_batches([_rows(out, _KINDS_FOUND)])

    return matched


def _match_windows(table: pa.Table) -> pa.Table:
    """Step 2 for windows that are dealt one by one: all but the first of equal ones repeat."""
    names, r, _, first, packs = _matched(table)
    out = {"block": names, "cover": [], "whole": [b""] * len(names), "more": [b""] * len(names)}
    for own, had in zip(packs, table.column("cover").to_pylist(), strict=True):
        out["cover"].append(had + _covers(r["doc"][own[~first[own]]], r["at"][own[~first[own]]]).tobytes())
    return pa.Table.from_batches([_rows(out, _KINDS_FOUND)])


def _covers(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), _COVER)
    out["doc"], out["start"], out["stop"] = doc, start, start + LENGTH
    return out


def _windows(b: Block, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, hash of the window, hash of its first k-gram) of all windows that reach over the anchors ``where``."""
    raw = np.frombuffer(b.raw, np.uint8)
    keys = (where["doc"].astype(np.int64)[:, None] << 32) + where["at"][:, None].astype(np.int64) - np.arange(SPAN)[None]
    fits = (where["at"][:, None] >= np.arange(SPAN)) & (where["at"][:, None] - np.arange(SPAN) + LENGTH <= (b.last - b.first)[where["doc"]][:, None])
    keys = np.unique(keys[fits])
    doc, start = keys >> 32, keys & ((1 << 32) - 1)
    window, gram = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    # a document at a time, so that the hash's powers stay few
    cuts = np.searchsorted(doc, np.unique(doc))
    for own in np.split(np.arange(len(keys)), cuts[1:]):
        if len(own):
            d = doc[own[0]]
            sums, back = _sums(raw[b.first[d] : b.last[d]])
            at = start[own]
            window[own] = mix((sums[at + LENGTH] - sums[at]) * back[at])
            gram[own] = mix((sums[at + KGRAM] - sums[at]) * back[at])
    return doc, start, window, gram


def _send_windows(hot: np.ndarray, n_buckets: int):
    """Windows over the suffixes with hot leading bytes, by the hash of each."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, more in zip(*(batch.column(c).to_pylist() for c in ("block", "path", "more")), strict=True):
                where = np.frombuffer(b"".join(more or []), _AT)
                b = Block.load(path) if len(where) else None
                where = where[np.isin(_lead(b, where["doc"].astype(np.int64), where["at"].astype(np.int64)), hot)] if b else where
                if not len(where):
                    continue
                doc, start, window, gram = _windows(b, where)
                rows, again = _step1(b, doc, start, np.zeros(len(doc), np.uint64), gram, window)
                bucket = (rows["context"] >> np.uint64(32)).astype(np.int64) * n_buckets >> 32
                yield _packs(name, rows, bucket, _covers(again["doc"], again["at"]), np.zeros(0, _AT))

    return sent


def _suffixes(b: Block, more: bytes) -> np.ndarray:
    """Suffixes with their left contexts at the places in ``more``."""
    where = np.frombuffer(more, _AT)
    rows = np.zeros(len(where), _STEP2)
    doc = where["doc"].astype(np.int64)
    at = b.first[doc] + where["at"]
    raw = np.frombuffer(b.raw, np.uint8)
    left, right = np.minimum(SPAN - 1, where["at"]), np.minimum(LENGTH, b.last[doc] - at)
    rows["doc"], rows["at"], rows["id"], rows["hash"], rows["left"], rows["right"] = doc, where["at"], b.ids[doc], b.hashes[doc] >> np.uint64(32), left, right
    for field, size, index in (("before", left, lambda k: at - 1 - k), ("after", right, lambda k: at + k)):
        for k in range(rows[field].shape[1]):
            some = size > k
            rows[field][some, k] = raw[index(k)[some]]
    return rows


def _send_suffixes(splitters: np.ndarray, hot: np.ndarray):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, path, more in zip(*(batch.column(c).to_pylist() for c in ("block", "path", "more")), strict=True):
                where = np.frombuffer(b"".join(more or []), _AT)
                b = Block.load(path) if len(where) else None
                lead = _lead(b, where["doc"].astype(np.int64), where["at"].astype(np.int64)) if b else np.zeros(0, np.uint64)
                calm = ~np.isin(lead, hot)
                if not calm.any():
                    continue
                rows = _suffixes(b, where[calm].tobytes())
                bucket = np.searchsorted(splitters, lead[calm], "right")
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by])) + 1
                parts = [(int(bucket[p[0]]), _pack(rows[p], False)) for p in np.split(by, cuts) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([name] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "block", "sent"])

    return sent


def _sample_suffixes(per_block: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, more in zip(batch.column("path").to_pylist(), batch.column("more").to_pylist(), strict=True):
                where = np.frombuffer(b"".join(more), _AT)
                some = where[np.random.default_rng(len(where)).permutation(len(where))[:per_block]]
                yield pa.RecordBatch.from_arrays([pa.array(_lead(Block.load(path), some["doc"].astype(np.int64), some["at"].astype(np.int64)).view(np.int64))], ["lead"])

    return sampled


def multikey_order(strings: np.ndarray) -> np.ndarray:
    """The order of rows of bytes. Multikey sort with characters of eight bytes: all groups of rows that agree so far are
    ordered by their next character together, and rows that stand alone are done."""
    n, width = strings.shape
    words = -(-width // 8)
    padded = np.zeros((n, 8 * words), np.uint8)
    padded[:, :width] = strings
    padded = padded.view(">u8").astype(np.uint64)
    order, group, todo = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for k in range(words):
        if not len(todo):
            break
        # todo: places in the order whose groups have several rows; such groups are runs of places
        key = padded[order[todo], k]
        by = np.lexsort((key, group[todo]))
        order[todo] = order[todo][by]
        g, key = group[todo], key[by]
        new = _firsts(g, key)
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        todo = todo[np.repeat(size > 1, size)]
    return order


def _common_prefix(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in the order, how many bytes it shares with the one before."""
    out = np.zeros(len(order), np.int64)
    s = strings[order]
    differs = s[1:] != s[:-1]
    out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return out


def repeated_windows(rows: np.ndarray) -> np.ndarray:
    """(rows, SPAN) booleans: the window that begins so many bytes before the suffix also starts earlier."""
    by = np.lexsort((rows["at"], rows["hash"], rows["id"]))
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    r = rows[by]
    when = np.cumsum(_firsts(r["id"], r["hash"], r["at"]))
    right, left = multikey_order(r["after"]), multikey_order(r["before"])
    shared = [_common_prefix(r["after"], right), _common_prefix(r["before"], left)]
    out = np.zeros((len(r), SPAN), bool)
    of = [np.empty(len(r), np.int64), np.empty(len(r), np.int64)]
    for offset in range(SPAN):
        for k, (order, least) in enumerate(((right, LENGTH - offset), (left, offset))):
            of[k][order] = np.cumsum(shared[k] < least) if least else 0
        fits = np.flatnonzero((r["left"] >= offset) & (r["right"] >= LENGTH - offset))
        if len(fits):
            _, first, group = np.unique(of[0][fits] * (len(r) + 1) + of[1][fits], return_index=True, return_inverse=True)
            out[fits, offset] = when[fits] > when[fits[first]][group]
    return out[back]


def _match_suffixes(table: pa.Table) -> pa.Table:
    """Step 2 in a bucket."""
    names, sent = table.column("block").to_pylist(), table.column("sent").to_pylist()
    rows, sizes = _unpack(sent, _STEP2, False)
    block = np.repeat(np.arange(len(names)), sizes)
    again = repeated_windows(rows)
    # offsets in a row give one run of bytes
    edge = np.diff(np.concatenate([np.zeros((len(rows), 1), np.int8), again.astype(np.int8), np.zeros((len(rows), 1), np.int8)], axis=1), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    cover = np.zeros(len(row), _COVER)
    cover["doc"], cover["start"], cover["stop"] = rows["doc"][row], rows["at"][row] - (high - 1), rows["at"][row] - low + LENGTH
    cuts = np.searchsorted(block[row], np.arange(len(names) + 1))
    out = {"block": names, "cover": [cover[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(names))], "whole": [b""] * len(names), "more": [b""] * len(names)}
    return pa.Table.from_batches([_rows(out, _KINDS_FOUND)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 for each block."""
    for batch in batches:
        for path, covers, wholes in zip(*(batch.column(c).to_pylist() for c in ("path", "covers", "wholes")), strict=True):
            b = Block.load(path)
            size, n = b.last - b.first, len(b.ids)
            cover, whole = np.frombuffer(b"".join(covers or []), _COVER), np.frombuffer(b"".join(wholes or []), _AT)
            doc = np.concatenate([cover["doc"], whole["doc"]]).astype(np.int64)
            at = whole["at"].astype(np.int64)
            start = np.concatenate([cover["start"], np.maximum(0, at - (SPAN - 1))]).astype(np.int64)
            stop = np.concatenate([cover["stop"], np.minimum(size[whole["doc"]], at + LENGTH)]).astype(np.int64)
            depth = np.zeros(len(b.raw) + 1, np.int32)
            np.add.at(depth, b.first[doc] + start, 1)
            np.add.at(depth, b.first[doc] + stop, -1)
            gone = np.cumsum(depth[:-1]) > 0
            raw = np.frombuffer(b.raw, np.uint8)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[b.last] - total[b.first]
            spans, kept = [], []
            for d in range(n):
                g, text = gone[b.first[d] : b.last[d]], raw[b.first[d] : b.last[d]]
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed[d] else 0)
                kept.append((text[~g] if removed[d] else text).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if x else int(i) for i, x in zip(b.ids, b.null, strict=True)], pa.int64()), pa.array(size), pa.array(removed.astype(np.int64)), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, and ``kept``, the bytes that stay, or with
    ``digest`` kept_sha256, their SHA-256 in hex.

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same. Null ids come before all others; documents with equal ids come in
    the order of a 32-bit hash of their texts, and rows that repeat both are one document, so that each of them gets its result.
    Texts of under LENGTH bytes stay whole. An empty table gives an empty result. Ids are integers; other columns are
    ignored. A character may lose some of its bytes, so ``kept`` is binary.
    """
    manifest = write_blocks(docs, id_col, text_col)
    total, n_blocks = manifest.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    total = total or 0
    spread = min(max(1, -(-total // (4 << 20))), 100_000)
    n_buckets = max(8, -(-total // (30 * BUCKET)))
    files = manifest.select("block", "path").repartition(spread)
    kinds = "block bigint, cover binary, whole binary, more binary"
    some = manifest.orderBy("block").limit(SAMPLED_BLOCKS).select("path")
    sample = some.mapInArrow(_sample_anchors(_share(n_buckets, n_blocks)), "lead bigint, gram bigint, context bigint").toPandas()
    splitters = _splitters({k: sample[k].to_numpy().view(np.uint64) for k in _TOKENS.names}, n_buckets)
    sent = files.mapInArrow(_send_anchors(splitters), "bucket bigint, block bigint, sent binary, cover binary, whole binary")
    found = materialise(sent.groupBy("bucket").applyInArrow(_match_contexts(np.unique(splitters["gram"])), kinds), "contexts")
    wanted = found.filter("length(more) > 0").groupBy("block").agg(F.collect_list("more").alias("more"))
    wanted = materialise(wanted.join(manifest.select("block", "path"), "block"), "wanted")
    n_suffixes = (found.agg(F.sum(F.length("more"))).first()[0] or 0) // _AT.itemsize
    n_sorted = max(8, -(-n_suffixes // SORTED))
    sample = wanted.orderBy("block").limit(SAMPLED_BLOCKS).mapInArrow(_sample_suffixes(_share(n_sorted, n_blocks)), "lead bigint").toPandas()["lead"].to_numpy().view(np.uint64)
    leads = np.sort(sample)[np.linspace(0, len(sample) - 1, n_sorted + 1).astype(int)[1:-1]] if len(sample) else np.zeros(0, np.uint64)
    leads, times = np.unique(leads, return_counts=True)
    hot = leads[times > 1]
    suffixes = wanted.repartition(spread).mapInArrow(_send_suffixes(leads, hot), "bucket bigint, block bigint, sent binary")
    all_found = [found, materialise(suffixes.groupBy("bucket").applyInArrow(_match_suffixes, kinds), "suffixes")]
    if len(hot):
        windows = wanted.repartition(spread).mapInArrow(_send_windows(hot, max(8, spread)), "bucket bigint, block bigint, sent binary, cover binary, whole binary")
        all_found.append(materialise(windows.groupBy("bucket").applyInArrow(_match_windows, kinds), "windows"))
    covers = reduce(DataFrame.unionByName, all_found).groupBy("block").agg(F.collect_list("cover").alias("covers"), F.collect_list("whole").alias("wholes"))
    blocks = manifest.select("block", "path").join(covers, "block", "left").drop("block")
    cut = blocks.repartition(spread).mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept") if digest else cut


def _share(n_buckets: int, n_blocks: int) -> int:
    """Sampled suffixes of a block."""
    wanted = min(max(LEAST_SAMPLE, PER_BUCKET * n_buckets), MOST_SAMPLE)
    return -(-wanted // max(1, min(n_blocks, SAMPLED_BLOCKS)))


def _splitters(sample: dict[str, np.ndarray], n_buckets: int) -> np.ndarray:
    """Tokens that cut the sample into equal parts; each once."""
    out = np.zeros(len(sample["gram"]), _TOKENS)
    for k in _TOKENS.names:
        out[k] = sample[k]
    if not len(out):
        return out
    out = out[_order(out)][np.linspace(0, len(out) - 1, n_buckets + 1).astype(int)[1:-1]]
    return out[_firsts(*(out[k] for k in _TOKENS.names))]
