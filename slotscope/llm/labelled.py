"""Bounded samples of labelled documents, and what the text classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of text that a sample holds at most, half of it for each class; and of one document.
SAMPLE_BYTES, DOCUMENT_BYTES = 128 << 20, 4 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """docs with label_value, for at most `rows` labelled documents of each class, those of the smallest id hashes; and each class's size.

    Rows whose fold of five is 0 are held out. The sample is bounded by `rows` and by SAMPLE_BYTES: documents that would exceed these bytes, or
    have more than DOCUMENT_BYTES, are left out of it. So its ids may be broadcast, and its words fit the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label_value"))
    sizes = {r["label_value"]: r["n"] for r in known.groupBy("label_value").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = [known.where(F.col("label_value") == v).withColumn("rank_hash", order).orderBy("rank_hash", "doc_id").limit(rows) for v in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("labelled_id"), "label_value", "rank_hash")
    met = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    measured = met.groupBy("labelled_id", "label_value", "rank_hash").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n")).collect()
    fits, left = [], {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}
    for r in sorted(measured, key=lambda r: (r["rank_hash"], r["labelled_id"])):
        if r["n"] <= min(left[r["label_value"]], DOCUMENT_BYTES):
            left[r["label_value"]] -= r["n"]
            fits.append((r["labelled_id"], r["label_value"]))
    fitting = docs.sparkSession.createDataFrame(fits, f"labelled_id {dict(labels.dtypes)['doc_id']}, label_value int")
    return docs.join(F.broadcast(fitting), F.col("doc_id") == F.col("labelled_id")).drop("labelled_id"), sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Adam's steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit_scale(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature that makes the weighted log loss of logits / temperature smallest, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        p = np.clip(sigmoid(logits / np.exp(log_t)), 1e-7, 1 - 1e-7)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    lo, hi, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
