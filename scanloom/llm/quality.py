"""Quality by naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words and word pairs, and runs of one to three word shapes. A
shape is the word's character classes with repeats collapsed ("Word," is "Aa,"), and whether the word equals the one
before it. Each indicator is scaled by its log-count ratio between the classes, vectors are brought to unit length, and
a linear model with hinge loss is fitted by dual coordinate descent. Margins of rows that a fold's model hasn't seen
calibrate a logistic curve.

Texts are worked on as one buffer of bytes: words are hashed with a polynomial modulo 2^64 over prefix sums, n-grams by
mixing neighbours, and indicators come from sorting (document, feature) keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.arrays import LOW_BYTES, SPACE_BYTES, hash_runs, mix, runs
from scanloom.llm.common import bounded_batches
from scanloom.llm.training import ROWS_PER_CLASS, held_out, labelled_sample, logistic, sigmoid

#: Bits of a hashed feature, sampled documents that a feature needs, bytes worked on at once.
BITS, LEAST, CHUNK = 18, 3, 1 << 20
FOLDS, ROUNDS, COST = 3, 12, 1.0
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for rows, doc, feature in indicators(texts):
            w = self.weights[0][feature]
            total = np.bincount(doc, w, len(rows))
            # vectors had unit length after scaling, so margins are divided by that length
            length = np.sqrt(np.bincount(doc, self.weights[1][feature], len(rows)))
            out[rows] += total / np.maximum(length, 1e-9)
        return out


def indicators(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, doc, feature): the distinct features of texts, some texts at a time; doc counts within rows. A text longer
    than CHUNK is worked on alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK) and to - at < 4096:
            size += len(texts[to]) + 1
            to += 1
        yield np.arange(at, to), *_features(texts[at:to])
        at = to


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    space = SPACE_BYTES[raw]
    first, last = runs(~space)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(ends_of_docs, first, "right")
    word = hash_runs(LOW_BYTES[raw], first, last)
    kind = _CLASS[raw]
    turn = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1])]) | np.concatenate([[True], space[:-1]]))
    shape = hash_runs(kind[turn], np.searchsorted(turn, first), np.searchsorted(turn, last))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = mix(shape + same.astype(np.uint64))
    near, far = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = mix(shape[:-1] * np.uint64(3) + shape[1:])
    sets = [
        (doc, word), (doc[1:][near], mix(word[:-1] * np.uint64(5) + word[1:] + np.uint64(1))[near]),
        (doc, shape + np.uint64(2)), (doc[1:][near], (two + np.uint64(3))[near]),
        (doc[2:][far], mix(two[:-1] * np.uint64(7) + shape[2:])[far]),
    ]
    keys = np.concatenate([(d.astype(np.uint64) << np.uint64(BITS)) | (mix(h) >> np.uint64(64 - BITS)) for d, h in sets])
    keys = np.unique(keys)
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights over features, the squared scales, and the bias, from arrays of features and labels 0 or 1.

    The weights hold the scale already: a text's margin is bias + sum(weights) / sqrt(sum of squared scales).
    """
    n = 1 << BITS
    counts = [np.zeros(n), np.zeros(n)]
    for features, c in zip(rows, y, strict=True):
        counts[int(c)][features] += 1
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[counts[0] + counts[1] < LEAST] = 0
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(rows))
    x = []
    for features in rows:
        r = ratio[features]
        x.append((features, r / max(np.sqrt(r @ r), 1e-9)))
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())]))
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            features, r = x[i]
            slope = sign[i] * (w[features] @ r + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[int(y[i])])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[features] += step * r
                bias += step
    return w * ratio, ratio * ratio, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class. Their features are made by executors; the driver gets
    4 * 2^BITS bytes a row at most."""
    sample, counts = labelled_sample(docs, labels, label, id_col, text_col, per_class)
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            out: list[bytes] = []
            for rows, doc, feature in indicators(texts):
                cuts = np.searchsorted(doc, np.arange(1, len(rows)))
                out += [part.astype(np.int32).tobytes() for part in np.split(feature, cuts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.select("doc_id", "text", "label").mapInArrow(made, f"doc_id {kind}, label int, x binary").collect())
    x, y = [np.frombuffer(r["x"], np.int32) for r in rows], np.array([r["label"] for r in rows], np.int64)
    if not rows or y.min() == y.max():
        _, offset = logistic(np.zeros((len(rows), 1)), y, counts)
        return QualityModel(np.zeros((2, 1 << BITS), np.float32), 0.0, 0.0, offset)
    fold, margin = np.random.default_rng(11).permutation(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        w, squares, bias = fit([x[i] for i in np.flatnonzero(fold != k)], y[fold != k])
        for i in np.flatnonzero(fold == k):
            margin[i] = bias + w[x[i]].sum() / max(np.sqrt(squares[x[i]].sum()), 1e-9)
    slope, offset = logistic(margin[:, None], y, counts)
    w, squares, bias = fit(x, y)
    return QualityModel(np.stack([w, squares]).astype(np.float32), bias, float(slope[0]), offset)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null, empty and blank texts have no features and get the score of the bias alone. Repeated rows get equal scores, and
    an empty table gives an empty result. Only the text is looked at.
    """
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sigmoid(model.slope * model.margins([t.as_py() or b"" for t in b.column("text")]) + model.offset)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, as they are.

    Documents don't shuffle, and only their texts go to Python, once; what comes back is a boolean each. Null, empty and
    blank texts have the score of the bias alone. Repeated rows go or stay together. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(sigmoid(model.slope * model.margins([t.as_py() or b"" for t in batch]) + model.offset) >= threshold)

    return docs.filter(good(F.col(f"`{text_col}`").cast("binary")))
