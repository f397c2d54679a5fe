"""Toxicity by a convolutional text classifier, trained in numpy by Spark tasks on all labelled documents outside the held-out fold.

Words and their first bytes are hashed to embedding rows, which are added; filters of several widths slide over the whole text; each filter's largest
response feeds a logistic layer. Max pooling makes the score independent of length, and a text is never cut.
A score needs the text alone; languages only have thresholds of their own, calibrated on a fifth of the labelled documents that isn't trained on.

Labelled documents are dealt into parts by their hashes, of bounded rows and bytes on average. In a round each task takes its part's steps from the
model so far; the moves are averaged by blocks of the embedding table, a bucket's over the parts that met it. Counts are summed over all parts, the
temperature and the thresholds come from sums over all checked documents, so the driver holds models and sums alone.

Defined results: null and empty texts get the score of a text without responses; rows that repeat get the same score; a null
or unknown language has threshold 0.5; no labels of one class give score 0.5 everywhere; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.labelled import Adam, fold, sigmoid
from slotscope.llm.shared import KeyFilter, cut, free_name, stash
from slotscope.llm.words import hash_segments

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: Bytes of a word's beginning, for words that share a stem.
PREFIX = 4
#: Buckets met in fewer documents stay at zero; the prior weight, in documents, of the classes' overall ratio.
LEAST_DOCS, PRIOR_DOCS = 4, 8
#: Labelled documents and bytes of their buckets in a part, on average; a part's steps are one task's.
PART_ROWS, PART_BYTES = 16_384, 64 << 20
#: Rounds over all parts. With one part there is no averaging, and its task takes all of its epochs at once.
EPOCHS, BATCH = 4, 64
#: Steps that few documents get at least, in up to 40 epochs.
LEAST_STEPS = 300
#: Buckets of a block when parts' arrays are summed, words of a text that are looked at together, and documents pooled together.
BLOCK, STRIP, POOLED = 1 << 10, 1 << 16, 64
GRID = np.linspace(0.05, 0.95, 91)


@dataclass
class Model:
    #: For each width and place in the filter, every bucket's part of the responses.
    parts: list[list[np.ndarray]]
    bias: np.ndarray
    weights: np.ndarray
    constant: float
    temperature: float
    #: What the classes' share adds to a logit: nothing, as training sees all rows in their own proportions.
    shift: float
    thresholds: dict[str, float]


def _pool(ids: np.ndarray, ends: np.ndarray, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each width, each document's largest responses (0 at least)."""
    pooled = []
    lengths = np.diff(ends)
    for tables in parts:
        w = len(tables)
        out = np.zeros((len(lengths), tables[0].shape[1]), np.float32)
        rows = np.flatnonzero(lengths >= w)
        if len(rows):
            n = len(ids) - w + 1
            total = tables[0][ids[:n, 0]] + tables[0][ids[:n, 1]]
            for j in range(1, w):
                total += tables[j][ids[j : j + n, 0]]
                total += tables[j][ids[j : j + n, 1]]
            # stretches alternate between a document's windows and those that cross its end
            cuts = np.stack([ends[:-1][rows], ends[1:][rows] - w + 1], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] >= n else cuts
            out[rows] = np.maximum.reduceat(total, cuts)[::2]
        pooled.append(np.maximum(out, 0))
    return pooled


@dataclass
class Weights:
    """What training moves: the embedding rows of known buckets, their squared moves, and the dense arrays (filters, bias, weights, constant)."""

    table: np.ndarray
    squares: np.ndarray
    dense: list[np.ndarray]
    known: np.ndarray

    def copy(self) -> Weights:
        return Weights(self.table.copy(), self.squares.copy(), [a.copy() for a in self.dense], self.known)

    def model(self) -> Model:
        *filters, bias, weights, constant = self.dense
        parts = [[np.ascontiguousarray(self.table @ f[j * DIMS : (j + 1) * DIMS]) for j in range(w)] for w, f in zip(WIDTHS, filters, strict=True)]
        return Model(parts, bias, weights, float(constant[0]), 1.0, 0.0, {})


def first_weights(seen: np.ndarray, sizes: np.ndarray, seed: int = 3) -> Weights:
    """seen: of each class and bucket, the documents that have it; sizes: of each class, its documents."""
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    # the first coordinate starts as each bucket's log ratio between the classes, drawn to 0; the others at random
    known = (seen.sum(0) >= LEAST_DOCS)[:, None]
    part = np.maximum(sizes / max(sizes.sum(), 1), 1e-9)
    table = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    table[:, 0] = np.log((seen[1] / part[1] + PRIOR_DOCS) / (seen[0] / part[0] + PRIOR_DOCS))
    table *= known
    filters = [rng.normal(0, 0.2, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters, strict=True):
        f[np.arange(w) * DIMS] += np.float32(0.5 / w)
    return Weights(table, np.full(BUCKETS, 1e-6, np.float32), [*filters, np.zeros(n_out, np.float32), np.full(n_out, 0.1, np.float32), np.zeros(1, np.float32)], known)


def _strongest(x: np.ndarray, table: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's responses to each filter are largest, and these, strip by strip; -1 and 0 in a text of fewer words than the filter."""
    best, top = np.full(FILTERS * len(WIDTHS), -1), np.zeros(FILTERS * len(WIDTHS), np.float32)
    for at in range(0, len(x), STRIP):
        emb = table[x[at : at + STRIP + max(WIDTHS) - 1]].sum(1)
        for g, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
            n, cols = min(STRIP, len(emb) - w + 1), slice(g * FILTERS, (g + 1) * FILTERS)
            if n > 0:
                total = sum(emb[j : j + n] @ f[j * DIMS : (j + 1) * DIMS] for j in range(w))
                here = total.argmax(0)
                value = total[here, np.arange(FILTERS)]
                more = (best[cols] < 0) | (value > top[cols])
                best[cols], top[cols] = np.where(more, here + at, best[cols]), np.where(more, value, top[cols])
    return best, top


def take_steps(ids: list[np.ndarray], y: np.ndarray, now: Weights, epochs: int, seed: int) -> Weights:
    """The weights after so many epochs over these documents."""
    now, rng = now.copy(), np.random.default_rng(seed)
    table, squares, known = now.table, now.squares, now.known
    *filters, bias, weights, constant = now.dense
    n_out = len(bias)
    adam, fit = Adam(now.dense, 0.01), np.arange(len(ids))
    for _ in range(epochs):
        rng.shuffle(fit)
        for begin in range(0, len(fit), BATCH):
            batch = fit[begin : begin + BATCH]
            pooled, best = np.zeros((len(batch), n_out), np.float32), np.full((len(batch), n_out), -1)
            for k, i in enumerate(batch):
                best[k], pooled[k] = _strongest(ids[i], table, filters)
            active = np.maximum(pooled + bias, 0)
            error = (sigmoid(active @ weights + constant[0]) - y[batch]) / len(batch)
            grad_pool = error[:, None] * weights * (pooled + bias > 0) * (best >= 0)
            grads = [np.zeros_like(f) for f in filters]
            rows, moves = [], []
            for k, i in enumerate(batch):
                for g, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                    for c in np.flatnonzero(grad_pool[k, g * FILTERS : (g + 1) * FILTERS]):
                        d, start = grad_pool[k, g * FILTERS + c], best[k, g * FILTERS + c]
                        window = ids[i][start : start + w]
                        grads[g][:, c] += d * table[window].sum(1).ravel()
                        rows.append(window.T.ravel())
                        moves.append(np.tile((d * f[:, c]).reshape(w, DIMS), (2, 1)))
            adam.step([*grads, (error[:, None] * weights * (pooled + bias > 0)).sum(0), active.T @ error, error.sum(keepdims=True)])
            if rows:
                rows, moves = np.concatenate(rows), np.concatenate(moves)
                touched, where = np.unique(rows, return_inverse=True)
                total = np.zeros((len(touched), DIMS), np.float32)
                np.add.at(total, where, moves)
                squares[touched] += (total**2).mean(1)
                table[touched] -= known[touched] * 0.02 * total / np.sqrt(squares[touched])[:, None]
    return now


def _by_part(batches, work):
    """What work makes of each part: its number, buckets, labels and marks of those checked. Rows stand in order of their parts."""
    number, held = None, []

    def done():
        buckets, labels, checks = (sum((r[k] for r in held), []) for k in range(3))
        return work(number, [np.frombuffer(b, np.uint16).reshape(-1, 2) for b in buckets], np.array(labels, np.float32), np.array(checks, bool))

    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and parts[i] != number:
                yield from done()
                held = []
            number, some = int(parts[i]), batch.slice(i, j - i)
            held.append([some.column(c).to_pylist() for c in ("ids", "label_value", "checked")])
    if held:
        yield from done()


SUMS = "block int, part int, data binary"


def _summed(rows: DataFrame, work, width: int) -> dict[int, np.ndarray]:
    """Sums of the parts' arrays by block, in order of the parts, so that reruns agree: work gives (block, array of so many columns)."""

    def each(batches):
        for block, part, data in _by_part(batches, lambda part, *given: [(b, part, a.astype(np.float64).tobytes()) for b, a in work(part, *given)]):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["block", "part", "data"])

    def add(key, tables):
        total, late = None, []
        for t in tables:
            late += zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True)
        for _, data in sorted(late):
            a = np.frombuffer(data, np.float64)
            total = a.copy() if total is None else total + a
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    got = rows.mapInArrow(each, SUMS).groupBy("block").applyInArrow(lambda key, t: pa.Table.from_batches(list(add(key, [t]))), "block int, data binary").collect()
    return {r["block"]: np.frombuffer(r["data"], np.float64).reshape(-1, width) for r in got}


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each class and bucket the documents trained on that have it, and of each class its documents."""

    def work(_, ids, y, checked):
        seen, sizes = np.zeros((BUCKETS, 2)), np.zeros((1, 2))
        for x, label, no in zip(ids, y, checked, strict=True):
            if not no:
                seen[np.unique(x), int(label)] += 1
                sizes[0, int(label)] += 1
        return [(-1, sizes), *((b, seen[b * BLOCK : (b + 1) * BLOCK]) for b in range(BUCKETS // BLOCK))]

    got = _summed(rows, work, 2)
    if not got:
        return np.zeros((2, BUCKETS)), np.zeros(2)
    return np.concatenate([got[b] for b in range(BUCKETS // BLOCK)]).T, got[-1][0]


def _first_response(rows: DataFrame, now: Weights) -> float:
    """The mean, over the documents trained on, of what the constant is added to."""
    shared = rows.sparkSession.sparkContext.broadcast(now.model())

    def work(_, ids, y, checked):
        mine, m = [x for x, no in zip(ids, checked, strict=True) if not no], shared.value
        return [(-1, np.array([[sum(float((_pooled_logits(mine[i : i + POOLED], m) - m.constant).sum()) for i in range(0, len(mine), POOLED)), len(mine)]]))]

    total, n = _summed(rows, work, 2)[-1][0]
    return total / n


def _round(rows: DataFrame, now: Weights, epochs: int, seed: int) -> Weights:
    """All parts' steps from these weights, averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(now)
    n_blocks, shapes = BUCKETS // BLOCK, [a.shape for a in now.dense]

    def work(part, ids, y, checked):
        mine, old = np.flatnonzero(~checked), shared.value
        if not len(mine):
            return []
        new = take_steps([ids[i] for i in mine], y[mine], old, epochs, seed + 1000 * part)
        moved = np.column_stack([new.table - old.table, new.squares - old.squares])
        every = np.column_stack([moved, (moved != 0).any(1)])
        dense = np.concatenate([(a - b).ravel() for a, b in zip(new.dense, old.dense, strict=True)])
        return [(-1, np.concatenate([dense, [1.0]])), *((b, every[b * BLOCK : (b + 1) * BLOCK]) for b in range(n_blocks))]

    got = _summed(rows, work, 1)
    dense, n = got[-1][:-1, 0], got[-1][-1, 0]
    every = np.concatenate([got[b] for b in range(n_blocks)]).reshape(BUCKETS, DIMS + 2)
    mean = every[:, :-1] / np.maximum(every[:, -1:], 1)
    cuts = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
    arrays = [(a + (dense[i:j] / n).reshape(a.shape)).astype(np.float32) for a, i, j in zip(now.dense, cuts[:-1], cuts[1:], strict=True)]
    return Weights((now.table + mean[:, :DIMS]).astype(np.float32), (now.squares + mean[:, DIMS]).astype(np.float32), arrays, now.known)


def _pooled_logits(ids: list[np.ndarray], model: Model) -> np.ndarray:
    return _logits(np.concatenate([*ids, np.zeros((0, 2), np.uint16)]), np.cumsum([0, *map(len, ids)]), model)


def _calibrate(rows: DataFrame, model: Model) -> None:
    """The model's temperature, and thresholds of languages with 20 checked documents and both classes: that of the best F1, of several the one nearest 0.5."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        for batch in batches:
            ids = [np.frombuffer(b, np.uint16).reshape(-1, 2) for b in batch.column("ids").to_pylist()]
            logits = [_pooled_logits(ids[i : i + POOLED], shared.value) for i in range(0, len(ids), POOLED)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label_value"), pa.array(np.concatenate([*logits, np.zeros(0)]))], ["lang", "label_value", "logit"])

    held = cut(rows.where("checked").select("lang", "label_value", "ids").mapInArrow(add, "lang string, label_value int, logit double"))
    if not held.head(1):
        return
    lo, hi = -2.0, 3.0
    away = F.col("logit") * (1 - 2 * F.col("label_value"))
    for _ in range(4):  # the loss has one valley; each pass cuts its stretch to a tenth
        steps = np.linspace(lo, hi, 21)
        found = held.agg(*[F.sum(F.round(F.log1p(F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), away / float(np.exp(t)))))), 9)).alias(f"t{k}") for k, t in enumerate(steps)]).first()
        k = int(np.argmin(list(found)))
        lo, hi = steps[max(0, k - 1)], steps[min(20, k + 1)]
    model.temperature = float(np.exp((lo + hi) / 2))
    scaled = F.lit(1.0) / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), F.col("logit") / model.temperature))))
    reached = sum((scaled >= float(g)).cast("int") for g in GRID)
    counts: dict[str, np.ndarray] = {}
    for r in held.where("lang IS NOT NULL").groupBy("lang", "label_value", reached.alias("reached")).count().collect():  # sums of a language
        counts.setdefault(r["lang"], np.zeros((2, len(GRID) + 1)))[r["label_value"], r["reached"]] += r["count"]
    for lang, n in counts.items():
        if n.sum() < 20 or not n.sum(1).all():
            continue
        hits = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # of each class, those that reach each threshold
        f1 = 2 * hits[1] / np.maximum(hits.sum(0) + n[1].sum(), 1e-9)
        best = GRID[f1 >= f1.max() - 1e-9]
        model.thresholds[lang] = float(best[np.argmin(np.abs(best - 0.5))])


def _logits(ids: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    pooled = np.concatenate(_pool(ids, ends, model.parts), 1).astype(float)
    return np.maximum(pooled + model.bias, 0) @ model.weights.astype(float) + model.constant


def bucket_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int32)


def _ids_of(wanted):
    """The buckets of the rows whose key the filter lets through."""

    def ids_of(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.has(batch.column("id_key").to_numpy())))
            rows = []
            for _, n, hashes, ends in hash_segments(batch.column("text"), prefix=PREFIX):
                ids = bucket_ids(hashes).astype(np.uint16)
                rows += [ids[ends[k] : ends[k + 1]].tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "ids"])

    return ids_of


def _with_labels(rows: pa.Table, given: pa.Table) -> pa.Table:
    """A part's rows that have a label, with it."""
    at = pc.index_in(rows.column("doc_id").combine_chunks(), value_set=given.column("doc_id").combine_chunks())
    label = given.column("label_value").take(at.drop_null())
    return rows.filter(at.is_valid()).select(["part", "lang", "ids"]).append_column("label_value", label)


def _dealt(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """All labelled rows outside the held-out fold, dealt into parts: label_value, lang, ids, checked, part; the parts' number and the rows trained on."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label_value"))
    same = known.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "label_value")
    some = docs.sparkSession.sparkContext.broadcast(KeyFilter(same.select(F.xxhash64("doc_id").alias("id_key")), "id_key"))
    source = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("id_key"))
    id_kind = dict(docs.dtypes)["doc_id"]
    made = source.mapInArrow(_ids_of(some), f"doc_id {id_kind}, lang string, ids binary").withColumn("deal", F.xxhash64(F.lit(5), "ids", "lang"))
    # labels meet narrow rows; the buckets are made again and travel once, to their part
    mark = lambda label: F.pmod(F.xxhash64(F.lit(5), "ids", label, "lang"), F.lit(5)) == 0
    narrow = made.select("doc_id", "deal", F.octet_length("ids").alias("n"), mark(F.lit(0)).alias("checked_0"), mark(F.lit(1)).alias("checked_1"))
    found = stash(narrow.join(same, "doc_id").withColumn("checked", F.when(F.col("label_value") == 1, F.col("checked_1")).otherwise(F.col("checked_0"))).select("doc_id", "label_value", "deal", "n", "checked"), "labelled")
    n_fit, n_bytes = found.agg(F.count_if(~F.col("checked")), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_parts = 1 + max(n_fit // PART_ROWS, n_bytes // PART_BYTES)
    part = F.pmod(F.shiftright("deal", 3), F.lit(n_parts)).cast("int").alias("part")
    given = found.select(part, "doc_id", "label_value").distinct().repartition(n_parts, "part").groupBy("part")
    sent = made.select(part, "doc_id", "lang", "ids").repartition(n_parts, "part").groupBy("part")
    met = sent.cogroup(given).applyInArrow(_with_labels, "part int, lang string, ids binary, label_value int")
    rows = met.select("label_value", "lang", "ids", "part", F.xxhash64(F.lit(5), "ids", "label_value", "lang").alias("h")).withColumn("checked", F.pmod("h", F.lit(5)) == 0)
    dealt = rows.select("label_value", "lang", "ids", "checked", "part", "h").sortWithinPartitions("part", "h", "ids", "label_value", "lang")
    return cut(dealt.drop("h")), n_parts, n_fit


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents outside the held-out fold."""
    rows, n_parts, n_fit = _dealt(docs, labels)
    seen, sizes = _counts(rows)
    now = first_weights(seen, sizes)
    if sizes.min() == 0:
        now.dense[-2][:] = 0
        return now.model()
    # the constant starts where the first responses meet the classes' ratio, so that steps go into telling them apart
    now.dense[-1][0] = np.log(sizes[1] / sizes[0]) - _first_response(rows, now)
    epochs = max(EPOCHS, min(40, LEAST_STEPS * BATCH // n_fit))
    for turn, each in enumerate([epochs] if n_parts == 1 else [1] * epochs):
        now = _round(rows, now, each, seed=turn + 4)
    model = now.model()
    _calibrate(rows, model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score, toxic_threshold (its language's) and toxic_flag."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxic_score", "toxic_threshold", "toxic_flag")  # columns of these names give way
    lang = free_name(docs, "toxic_lang")
    keyed = docs.withColumn(lang, F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string"))

    def add(batches):
        m = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, n, hashes, ends in hash_segments(batch.column("text"), prefix=PREFIX):
                scores[i : i + n] = np.round(sigmoid((_logits(bucket_ids(hashes), ends, m) + m.shift) / m.temperature), 9)
            limits = np.array([m.thresholds.get(x, 0.5) for x in batch.column(lang).to_pylist()], float)
            kept = batch.drop_columns([lang])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores), pa.array(limits), pa.array(scores >= limits)], [*kept.schema.names, "toxic_score", "toxic_threshold", "toxic_flag"])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema)
    return keyed.mapInArrow(add, f"{kinds}, toxic_score double, toxic_threshold double, toxic_flag boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
