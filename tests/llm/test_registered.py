"""The registered queries themselves, over a whole small table, against brute force; and the classifiers' scores against a plain forward pass."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotscope.llm import exact_dedup, quality, shared, toxicity
from slotscope.llm.queries import QUERIES
from slotscope.llm.words import BASE, BYTE_VALUE

from .test_dedup import near_truth, repeat_truth
from .test_scores import SPACED, language_truth, targets_by_rounds

SF = "/root/testdata/sf0.001"
WRAP = (1 << 64) - 1


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op1_removes_the_bytes_that_brute_force_removes(spark, texts):
    wanted = Counter()
    for (i, n, spans, kept), times in repeat_truth(texts, 50).items():
        wanted[(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += times
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_suffix_array"](spark, SF).collect()) == wanted


def test_op2_takes_what_the_targets_ask_for_through_the_shards(spark, texts):
    sizes, source = defaultdict(int), {}
    for i, t, s in texts:
        sizes[s] += len(SPACED.findall(t or ""))
        source[i] = s
    wanted, taken = targets_by_rounds(sizes), Counter()
    got = QUERIES["op2_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(source)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s])
        assert len([x for x in r.shards.split(",") if x]) == r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    longest = max(len(SPACED.findall(t or "")) for _, t, _ in texts)
    assert all(abs(taken[s] - wanted[s]) <= longest / 2 + 1 for s in wanted)
    again = QUERIES["op2_mixing"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op4_finds_the_components_of_all_pairs(spark, texts):
    got = QUERIES["op4_near_dedup"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(texts, 3, 85)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_op10_scores_as_counts_in_dictionaries_do(spark, texts):
    got = QUERIES["op10_language_model"](spark, SF).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    wanted = {key(t): t for t in language_truth(texts)}
    assert len(got) == len(wanted)
    for r in got:
        mine = wanted[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)]
        assert r.base_score == pytest.approx(mine[5], abs=1e-3) and r.score == pytest.approx(mine[6], abs=1e-3)


def mixed(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & WRAP
    return x ^ x >> 32


def word_hash(word):
    total, power = 0, 1
    for b in word:
        total, power = total + int(BYTE_VALUE[b]) * power & WRAP, power * int(BASE) & WRAP
    return mixed(total)


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_op7_scores_are_those_of_a_plain_forward_pass(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    for i, text, _ in texts[:60]:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", lowered(text))
        ids = [(word_hash(w) >> 48, mixed(word_hash(w[: toxicity.PREFIX]) ^ toxicity.PREFIX) >> 48) for w in words]
        pooled = []
        for tables in model.parts:
            sums = [sum(tables[j][k].astype(float) for j in range(len(tables)) for k in ids[at + j]) for at in range(len(ids) - len(tables) + 1)]
            pooled += list(np.maximum(np.max(sums, 0), 0)) if sums else [0.0] * toxicity.FILTERS
        logit = float(np.maximum(np.array(pooled) + model.bias, 0) @ model.weights + model.constant)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(logit + model.shift) / model.temperature)), abs=1e-4)


def test_op8_scores_are_those_of_a_plain_forward_pass(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op8_quality"](spark, SF).collect()}
    for i, text, _ in texts[:60]:
        segments = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x00-\x20\x7f-\xff]+", lowered(text))
        v = np.array([model.vectors[word_hash(s) >> 50] for s in segments], float).reshape(-1, quality.DIMS)
        beside = (v[:-1] * v[1:]).sum(0) / max(len(v) - 1, 1)
        features = np.concatenate([v.mean(0), v.std(0), beside]) if len(v) else np.zeros(quality.POOLED)
        hidden = np.tanh((features - model.centre) / model.scale @ model.w1 + model.b1)
        logit = float(hidden @ model.w2 + model.b2)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(logit + model.shift) / model.temperature)), abs=1e-3)


def test_key_filters_miss_no_key_and_drop_most_others(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS k")
    found = shared.KeyFilter(keys, "k")
    held = np.array([r.k for r in keys.collect()], np.int64)
    assert found.has(held).all()
    others = np.array([r.k for r in spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS k").collect()], np.int64)
    assert found.has(others).mean() < 0.05
    assert not shared.KeyFilter(keys.limit(0), "k").has(others).any()


def test_partitions_grow_with_bytes_where_there_is_no_estimate(spark):
    rows = spark.createDataFrame([(i, "x" * 10_000) for i in range(100)], "doc_id long, text string")
    assert shared.n_parts(rows, 10_000) > 40
    assert shared.n_parts(rows.where("doc_id >= 0").select("text"), 10_000) > 40
    assert shared.n_parts(spark.createDataFrame([], "doc_id long, text string"), 10_000) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_are_shuffled_for_suspects_alone(spark):
    """Of texts that occur once, next to none passes the filter."""
    docs = spark.createDataFrame([(i, f"text {i % 950} of its own") for i in range(1000)], "doc_id long, text string")
    source = docs.selectExpr("text", "xxhash64(doc_id, text) AS row_key")
    twice = spark.createDataFrame([(i,) for i in [*range(50), *range(950, 1000)]], "doc_id long").join(docs, "doc_id").selectExpr("xxhash64(doc_id, text) AS row_key")
    wanted = spark.sparkContext.broadcast(shared.KeyFilter(twice, "row_key"))
    assert 100 <= source.select("row_key", "text").mapInArrow(exact_dedup._bodies(wanted), "row_key long, sha binary, body binary").count() < 150
