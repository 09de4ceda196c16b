"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled samples. The ordinary one is trained on windows of ordinary texts. The
toxic one is trained on those stretches of toxic texts whose GRAM-grams of bytes significantly more toxic than ordinary
documents have, and it is laid before the ordinary content: toxic texts consist of ordinary words for the most part, and
what is in both dictionaries at the same place cancels. (Two dictionaries trained on whole texts of either class differ
in so many ordinary syllables that the few toxic words drown: see the README.) A text is cut into windows of about WINDOW
bytes at white space, and each window is compressed with either dictionary. The bytes saved by the toxic one, summed up
by the best windows and by how many pass each of several thresholds, go through a logistic curve. It is calibrated on
labelled documents that the dictionaries of their fold haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import LOWER, UPPER, bounded_batches
from scanloom.llm.training import held_out, labelled_sample, logistic, sigmoid

WINDOW = 64
#: Labelled rows of a class that the dictionaries and the curve are fitted on at most.
ROWS_PER_CLASS = 4000
#: Bytes of the dictionaries, and segment and match lengths of their training.
ORDINARY, TOXIC, SEGMENT, MATCH = 8192, 1024, 24, 6
#: Bits of a compressor's window and tables: enough for both dictionaries and a window of text.
REACH = (ORDINARY + TOXIC + WINDOW).bit_length()
#: Bytes of a gram and bits of its hash; toxic documents that it needs, and its z-score, at least; and both as the sample
#: grows, as a share of its toxic documents and times the square root of their number.
GRAM, BITS, LEAST, Z, SHARE, Z_GROWS = 7, 22, 5, 4.0, 0.01, 0.19
#: Windows of ordinary text that the dictionary is trained on at most, evenly over the sample's texts.
TRAINING_WINDOWS = 200_000
#: Bytes saved from which on a window counts, one feature for each.
SAVED = (2, 3, 4, 5, 6)
N_FEATURES = 6 + len(SAVED)
_UP = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float


def folded(text: bytes) -> bytes:
    """A text lower-cased in A-Z, its lines joined, with a space at either end."""
    return b" " + text.translate(_UP).replace(b"\n", b" ") + b" "


def gram_hashes(text: bytes) -> np.ndarray:
    """A hash of each GRAM-gram of a text."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(raw) - GRAM + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        h = h * np.uint64(257) + raw[k : k + n]
    return (h * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def significant(counts: list[np.ndarray], n: list[int]) -> np.ndarray:
    """True for grams that significantly more toxic documents have, from how many documents of each class have each gram.

    z is the signed root of the likelihood ratio of two rates and one. It grows with the sample also for a gram that no
    ordinary document has, where log odds over their standard error hardly do.
    """
    enough = np.flatnonzero(counts[1] >= max(LEAST, SHARE * n[1]))
    k = [np.minimum(c[enough], m).astype(np.float64) for c, m in zip(counts, n, strict=True)]
    both = (k[0] + k[1]) / max(1, sum(n))
    gain = np.zeros(len(enough))
    for c, m in zip(k, n, strict=True):
        for have, expected in ((c, m * both), (m - c, m * (1 - both))):
            gain += have * np.log(np.maximum(have, 1e-9) / np.maximum(expected, 1e-9))
    z = np.sqrt(2 * np.maximum(gain, 0)) * np.sign(k[1] * n[0] - k[0] * n[1])
    out = np.zeros(len(counts[1]), bool)
    out[enough[z >= max(Z, Z_GROWS * np.sqrt(n[1]))]] = True
    return out


def stretches(text: bytes, wanted: np.ndarray) -> list[bytes]:
    """The distinct runs of a text's bytes that lie in wanted grams, in order."""
    at = np.flatnonzero(wanted[gram_hashes(text)])
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + GRAM, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]]).astype(np.int8)))
    return list(dict.fromkeys(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on ``samples``, without the entropy tables, which would differ for the two
    dictionaries. Too few samples to train on are the content themselves."""
    samples = [samples[k] for k in np.random.default_rng(5).permutation(len(samples))]  # each part of them alike
    try:
        found = zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return found[len(found) - min(len(found) * 7 // 8, len(found) - 256) :] if len(found) > 600 else found


def windows(text: bytes) -> list[bytes]:
    """A text, lower-cased in A-Z, in pieces of at most WINDOW bytes, cut before white space where there is some."""
    text, out, at = folded(text)[:-1], [], 0
    while at < len(text):
        to = at + WINDOW
        if to < len(text):
            cut = text.rfind(b" ", at + WINDOW // 2, to)
            to = cut if cut > 0 else to
        out.append(text[at:to])
        at = to
    return out


def compressor(content: bytes):
    # chains and hashes span both dictionaries: with fewer bits the toxic one, which lies farthest back, is hardly found
    parameters = zstandard.ZstdCompressionParameters(
        window_log=REACH, chain_log=REACH, hash_log=REACH, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress


def features(text: bytes, ordinary, toxic) -> list[float]:
    saved = np.minimum([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], 10)
    best = np.zeros(3)
    best[: min(3, len(saved))] = np.sort(saved)[::-1][:3]
    passed = [np.log1p((saved >= k).sum()) for k in SAVED]
    return [*map(float, best), *map(float, passed), float(np.log(len(saved))), float(saved.mean()), float((saved >= 4).mean())]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class. Each half of them calibrates dictionaries of the other; the
    model's own dictionaries are trained on all.

    What is counted and cut out of texts is so by executors. The driver gets counts, the stretches, and at most
    TRAINING_WINDOWS windows.
    """
    sample, counts = labelled_sample(docs, labels, label, id_col, text_col, per_class)
    bounded_batches(docs.sparkSession)
    n_texts = max(1, sum(min(c, per_class) for c in counts))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its distinct grams, and some of its windows if it is ordinary."""
        for b in batches:
            for part, y, text in zip(*(b.column(c).to_pylist() for c in ("part", "label", "text")), strict=True):
                raw = (text or "").encode()
                some = windows(raw) if y == 0 else []
                share = max(1, TRAINING_WINDOWS // n_texts)
                some = [some[k] for k in np.unique(np.linspace(0, len(some) - 1, min(share, len(some))).astype(int))] if some else []
                grams = np.unique(gram_hashes(folded(raw))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([y], pa.int32()), pa.array([grams.tobytes()], pa.binary()), pa.array([some], pa.list_(pa.binary()))], ["part", "label", "grams", "windows"])

    seen, n, plain = np.zeros((2, 2, 1 << BITS), np.float32), np.zeros((2, 2), int), [[], []]
    for r in sample.mapInArrow(met, "part int, label int, grams binary, windows array<binary>").toLocalIterator():
        seen[r["part"], r["label"]][np.frombuffer(r["grams"], np.int32)] += 1
        n[r["part"], r["label"]] += 1
        plain[r["part"]] += map(bytes, r["windows"])
    # dictionaries of either half and of both; the order of samples must not depend on that of rows
    wanted = [significant(list(seen[list(p)].sum(0)), [int(k) for k in n[list(p)].sum(0)]) for p in ((0,), (1,), (0, 1))]
    ordinary = [trained(sorted(w for k in p for w in plain[k]), ORDINARY) for p in ((0,), (1,), (0, 1))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text in zip(*(b.column(c).to_pylist() for c in ("part", "text")), strict=True):
                found = [stretches(folded((text or "").encode()), wanted[k]) for k in (part, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([f], pa.list_(pa.binary())) for f in found)], ["part", "own", "both"])

    pieces: list[list[bytes]] = [[], [], []]
    for r in sample.filter("label = 1").mapInArrow(cut, "part int, own array<binary>, both array<binary>").toLocalIterator():
        pieces[r["part"]] += map(bytes, r["own"])
        pieces[2] += map(bytes, r["both"])
    toxic = [trained(sorted(p), TOXIC) + base for p, base in zip(pieces, ordinary, strict=True)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(compressor(o), compressor(t)) for o, t in zip(ordinary[:2], toxic[:2], strict=True)]
        for b in batches:
            x = [features((t or "").encode(), *pairs[1 - p]) for p, t in zip(b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = sorted((r["x"], r["label"]) for r in sample.mapInArrow(measured, "label int, x array<double>").collect())
    x, y = np.array([r[0] for r in rows], np.float64).reshape(len(rows), N_FEATURES), np.array([r[1] for r in rows])
    return ToxicityModel(ordinary[2], toxic[2], *logistic(x, y, counts))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Every window of a text counts. Null and empty texts are one blank window. Repeated rows get equal scores, and an empty
    table gives an empty result. Only the text is looked at.
    """
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = compressor(model.ordinary), compressor(model.toxic)
        for batch in batches:
            x = np.array([features(t.as_py() or b"", a, b) for t in batch.column("text")])
            p = sigmoid(x @ model.weights + model.bias) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
