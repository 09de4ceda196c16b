"""Bounded samples of labelled documents, and calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import materialise

#: Labelled rows of a class that a classifier is fitted on at most: those with the smallest hashes of their ids.
ROWS_PER_CLASS = 2000


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model may see: CRC-32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, label, part) of ``per_class`` rows of each class at most, none of them held out, and how many labels
    of each class there are. part is 0 or 1, from a hash of the id. A row labelled twice has the larger label."""
    known = labels.filter(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).alias("label"))
    known = materialise(known.filter("doc_id is not null"), "labels")
    counts = dict(known.groupBy("label").count().collect())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = None
    for c in (0, 1):
        some = known.filter(F.col("label") == c).orderBy(*order).limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    part = F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(2)).cast("int").alias("part")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most 2 * per_class ids: small enough to send everywhere
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", part)
    return materialise(found, "sample"), [counts.get(0, 0), counts.get(1, 0)]


def logistic(x: np.ndarray, y: np.ndarray, counts: list[int], ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Newton's method, with the bias moved from the sample's share of
    label 1 to that of ``counts``."""
    x = np.asarray(x, np.float64)
    n, k = x.shape
    if not n or y.min() == y.max():
        p = (counts[1] + 0.5) / (sum(counts) + 1)
        return np.zeros(k), float(np.log(p / (1 - p)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
    w, keep = np.zeros(k + 1), np.diag([ridge * n] * k + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:k] / scale
    shift = np.log((counts[1] + 0.5) / (counts[0] + 0.5)) - np.log((y == 1).sum() / (y == 0).sum())
    return weights, float(w[k] - weights @ mean + shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
