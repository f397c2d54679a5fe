"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

A segment (a run of word bytes or of other marks) is hashed to a bucket; each bucket has a fixed sparse index vector
of +1 and -1. A bucket's word vector is the sum of the index vectors met within two segments of it, over every document:
integer counts, which map tasks sum before they are shuffled, so that the order of rows decides nothing. A document
is the mean and the spread of its segments' vectors and the mean product of neighbours; a small network trained in numpy on a bounded sample of
labelled documents turns them into a probability, whose temperature is fitted on part of the sample.

Defined results: null and empty texts get the score of a document whose vectors are zero; rows that repeat get the same
score; no labels of one class give score 0.5 everywhere; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotscope.llm.labelled import Adam, fit_scale, labelled_sample, sigmoid
from slotscope.llm.words import hash_segments, stream

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Features of a document.
POOLED = 3 * DIMS
#: Rows of the vector table that are summed together.
SLICE = 256
#: Labelled documents of each class that training takes at most.
SAMPLE_ROWS = 8_000
HIDDEN, EPOCHS, BATCH = 32, 30, 64

_random = stream(BUCKETS * NONZERO, 17).reshape(BUCKETS, NONZERO)
INDEX_AT = (_random % np.uint64(DIMS)).astype(np.int64)
INDEX_SIGN = np.where(_random >> np.uint64(63), 1.0, -1.0)


def bucket_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def _count_contexts(batches):
    """A task's context sums, a row for each slice of the table."""
    total = np.zeros(BUCKETS * DIMS)
    met = False
    for batch in batches:
        for _, _, hashes, ends in hash_segments(batch.column(0), marks=True):
            ids = bucket_ids(hashes)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for gap in range(1, REACH + 1):
                if len(ids) <= gap:
                    continue
                same = row[gap:] == row[:-gap]
                left, right = ids[:-gap][same], ids[gap:][same]
                for word, near in ((left, right), (right, left)):
                    for z in range(NONZERO):
                        total += np.bincount(word * DIMS + INDEX_AT[near, z], weights=INDEX_SIGN[near, z], minlength=BUCKETS * DIMS)
            met = met or len(ids) > 0
    if met:
        parts = total.astype(np.int64).reshape(-1, SLICE * DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "sums"])


def _add_slices(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in rows.column("sums").to_pylist())
    return pa.table({"slice": rows.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, learned from all documents: each of length 1, with a share of the bucket's own index vector."""
    sums = docs.select("text").mapInArrow(_count_contexts, "slice long, sums binary").groupBy("slice").applyInArrow(_add_slices, "slice long, sums binary").collect()
    table = np.zeros((BUCKETS // SLICE, SLICE * DIMS))
    for r in sums:  # a table of fixed size, whatever the documents
        table[r["slice"]] = np.frombuffer(r["sums"], np.int64)
    table = table.reshape(BUCKETS, DIMS)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], INDEX_AT), INDEX_SIGN / NONZERO**0.5)
    return (table + own).astype(np.float32)


def pool(ids: np.ndarray, ends: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each document's vectors, and the mean product of neighbouring ones, which is high where segments repeat."""
    lengths = np.diff(ends)
    out = np.zeros((len(lengths), POOLED), np.float32)
    rows = np.flatnonzero(lengths)
    if len(rows):
        v = vectors[ids]
        n = lengths[rows][:, None]
        mean = np.add.reduceat(v, ends[:-1][rows], dtype=np.float64) / n
        square = np.add.reduceat(v * v, ends[:-1][rows], dtype=np.float64) / n
        out[rows, :DIMS], out[rows, DIMS : 2 * DIMS] = mean, np.sqrt(np.maximum(square - mean**2, 0))
        beside = np.zeros_like(v)
        beside[:-1] = v[:-1] * v[1:]
        beside[ends[1:][rows] - 1] = 0  # a document's last segment has none after it
        out[rows, 2 * DIMS :] = np.add.reduceat(beside, ends[:-1][rows], dtype=np.float64) / np.maximum(n - 1, 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    shift: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.centre).astype(float) / self.scale @ self.w1.astype(float) + self.b1)
        return hidden @ self.w2.astype(float) + self.b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Rounded, so that how rows are batched shows in no digit."""
        return np.round(sigmoid((self.logits(features) + self.shift) / self.temperature), 9)


def train(features: np.ndarray, y: np.ndarray, vectors: np.ndarray, sizes: dict[int, int], seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(vectors, features.mean(0), features.std(0) + 1e-3, rng.normal(0, 0.15, (POOLED, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), 0.0, 0.0, 1.0)
    if min(np.sum(y == 0), np.sum(y == 1)) == 0:
        return model
    model.w2 = rng.normal(0, 0.15, HIDDEN).astype(np.float32)
    b2 = np.zeros(1, np.float32)
    order = rng.permutation(len(y))
    check, fit = order[: len(y) // 5], order[len(y) // 5 :]
    x = ((features - model.centre) / model.scale).astype(np.float32)
    adam = Adam([model.w1, model.b1, model.w2, b2], 0.003)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH]
            hidden = np.tanh(x[rows] @ model.w1 + model.b1)
            error = (sigmoid(hidden @ model.w2 + b2[0]) - y[rows]) / len(rows)
            back = error[:, None] * model.w2 * (1 - hidden**2)
            adam.step([x[rows].T @ back + 1e-4 * model.w1, back.sum(0), hidden.T @ error + 1e-4 * model.w2, error.sum(keepdims=True)])
    model.b2 = float(b2[0])
    part = {v: float(np.sum(y == v)) for v in (0, 1)}
    prior = {v: sizes.get(v, 0) / max(part[v], 1) for v in (0, 1)}
    model.shift = float(np.log(max(prior[1], 1e-9) / max(prior[0], 1e-9)))
    model.temperature = fit_scale(model.logits(features[check]) + model.shift, y[check], np.where(y[check] == 1, prior[1], prior[0]))
    return model


def _features_of(vectors):
    def features(batches):
        for batch in batches:
            rows = []
            for _, _, hashes, ends in hash_segments(batch.column("text"), marks=True):
                rows += [x.tobytes() for x in pool(bucket_ids(hashes), ends, vectors.value)]
            yield pa.RecordBatch.from_arrays([batch.column("label_value"), pa.array(rows, pa.binary())], ["label_value", "features"])

    return features


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all docs, and a network from at most `rows` labelled documents of each class."""
    vectors = word_vectors(docs)
    sample, sizes = labelled_sample(docs.select("doc_id", "text"), labels, "quality", rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    got = sample.select("label_value", "text").mapInArrow(_features_of(shared), "label_value int, features binary").toArrow()
    found = sorted(zip(got.column("features").to_pylist(), got.column("label_value").to_pylist(), strict=True))
    features = np.array([np.frombuffer(f, np.float32) for f, _ in found] or [np.zeros(POOLED, np.float32)])
    return train(features, np.array([v for _, v in found] or [0], np.float32), vectors, sizes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score."""
    docs = docs.drop("quality_score")  # a column of this name gives way
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, n, hashes, ends in hash_segments(batch.column("text"), marks=True):
                scores[i : i + n] = shared.value.scores(pool(bucket_ids(hashes), ends, shared.value.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "quality_score"])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema)
    return docs.mapInArrow(add, f"{kinds}, quality_score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
