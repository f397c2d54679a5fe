"""Mixing, decontamination, counts, classifiers, URL filters, language model and the pipeline."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotscope.llm import decontaminate, language_model, mixing, quality, routing, token_counts, toxicity, url_filter
from slotscope.llm.labelled import fit_scale
from slotscope.llm.queries import SQL, QUERIES

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_rounds(sizes, share=1.5, most=2.0):
    """Shares by weight; what is above a stop goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        open_names = [s for s in names if s not in stopped]
        level = left / sum(weight[s] for s in open_names) if open_names else 0
        over = [s for s in open_names if level * weight[s] > most * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in open_names}
        for s in over:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def test_mixing(docs, no_docs, rows):
    got = mixing.taken_words(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    wanted = targets_by_rounds(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(SPACED.findall(r[1] or ""))) for r in rows)
    source = {(r[0], len(SPACED.findall(r[1] or ""))): r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = max(len(SPACED.findall(r[1] or "")) for r in rows)
    assert all(abs(taken[s] - wanted[s]) <= longest / 2 + 1 for s in wanted)
    again = mixing.taken_words(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.taken_words(no_docs).count() == 0


def test_mixing_of_many_blocks_draws_each_disjointly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = mixing.sized(docs, 7)
    targets = mixing.source_targets(slim)
    copies = mixing.mix(slim, targets, 6, shard_words=600).collect()
    assert len({(r.uid, r.copy) for r in copies}) == len(copies)  # no copy is drawn twice
    shards = defaultdict(list)
    for r in copies:
        shards[r.shard].append(r.position)
    assert len(shards) > 10 and all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())
    taken, wanted = defaultdict(int), {r.sid: r.target for r in targets.collect()}
    for r in copies:
        taken[r.sid] += r["size"]
    assert all(abs(taken[s] - wanted[s]) <= 16 for s in wanted)


def test_mixing_of_more_shards_than_slices_have_blocks(spark, monkeypatch):
    """Slices of two blocks, nodes dealt out after each level, many small shards: none has more than its even part of the blocks and one."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 2)
    monkeypatch.setattr(mixing, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(mixing, "DEALT_LEVELS", 1)
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7 + 1)), "hot" if i % 3 else f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    slim = mixing.sized(docs, 7)
    targets = mixing.source_targets(slim)
    got = mixing.mix(slim, targets, 3, shard_words=40).collect()
    assert len({(r.uid, r.copy) for r in got}) == len(got)
    blocks = defaultdict(set)
    for r in got:
        blocks[r.shard].add((r.sid, r.block, r.copy))
    sizes = [len(b) for b in blocks.values()]
    assert len(sizes) > 50 and max(sizes) - min(sizes) <= 3
    taken, wanted = Counter(), {r.sid: r.target for r in targets.collect()}
    for r in got:
        taken[r.sid] += r["size"]
    assert all(abs(taken[s] - wanted[s]) <= 4 for s in wanted)


def test_rows_of_one_id_and_text_keep_their_own_source(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s2"), (1, "a b c", "s2"), (None, "d e f", "s1"), (None, "d e f", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter()
    for r in mixing.mixed_documents(docs).collect():
        copies[(r.doc_id, r.text, r.source)] += 1
    slim, _, places = mixing.mix_documents(docs)
    named = {r.uid: (r.doc_id, r.source) for r in slim.collect()}
    wanted = Counter(named[r.uid] for r in places.collect())
    assert {(i, s): n for (i, _, s), n in copies.items()} == dict(wanted)


def test_splitting_keeps_quotas_and_follows_the_hypergeometric_law(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 25), (2, 0), (3, 7)], "sid long, quota long")
    got = mixing.shard_quotas(quotas, 5, 3).collect()
    for sid, quota in ((0, 40), (1, 25), (2, 0), (3, 7)):
        mine = sorted((r["first"], r.n_blocks) for r in got if r.sid == sid)
        assert sum(n for _, n in mine) == quota and all(n > 0 for _, n in mine)
        assert [f for f, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))]  # disjoint stretches that cover all blocks
    total = Counter()
    for r in got:
        total[r.shard] += r.n_blocks
    assert len(total) == 5 and max(total.values()) - min(total.values()) <= 3
    n, k, d = 60, 20, 15
    draws = spark.range(4000).select(mixing.hypergeometric((F.col("id") + 0.5) / 4000, F.lit(n), F.lit(k), F.lit(d)).alias("x")).groupBy("x").count().collect()
    for r in draws:
        law = math.comb(k, r.x) * math.comb(n - k, d - r.x) / math.comb(n, d)
        assert r["count"] / 4000 == pytest.approx(law, abs=1 / 1000)


def decontamination_truth(rows, items, size=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - size, 0) + 1) if w else ():
            windows[tuple(w[s : s + size])].add("null" if item is None else str(item))
    out = Counter()
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if names := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= names
        out[(i, len(w), len(hit), ",".join(sorted(found)))] += 1
    return out


def found_contamination(docs, benchmark):
    out = Counter()
    for r in decontaminate.decontaminate(docs, benchmark).withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect():
        out[(r.doc_id, r.n_words, r.n_hit or 0, ",".join(sorted(r["items"] or [])))] += 1
    return out


def test_decontamination(spark, docs, no_docs, rows):
    long = rows[3][1].split()
    items = [(1, " ".join(long[5:30])), (2, rows[5][1]), (3, None), (4, ""), (None, " ".join(rows[0][1].split()[:12]).upper()), (5, "Ärger"), (1, "changed"), (6, "w1 " * 30), (7, "--")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = decontamination_truth(rows, items)
    assert found_contamination(docs, benchmark) == wanted
    assert any(k[2] for k in wanted)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(k[2] == 0 for k in found_contamination(docs, none))
    assert decontaminate.decontaminate(no_docs, benchmark).count() == 0
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(v for k, v in wanted.items() if not k[2])


def test_decontamination_by_a_shuffle(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    items = [(1, rows[0][1]), (2, "w1 w2")]
    assert found_contamination(docs, spark.createDataFrame(items, "item_id long, text string")) == decontamination_truth(rows, items)


def test_token_counts_and_their_cache(spark, docs, no_docs, rows, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path, cache = P.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = Counter((r[0], len((r[1] or "").encode()), len(coder.encode(r[1] or ""))) for r in rows)
    count = lambda d: Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(d, path, cache).collect())
    assert count(docs) == wanted
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in rows})  # each text once
    assert count(docs) == wanted and spark.read.parquet(cache).count() == stored  # and not again
    more = spark.createDataFrame([(1, "a new text </s> <s>"), (2, rows[0][1])], "doc_id long, text string")
    assert count(more) == Counter([(1, 19, len(coder.encode("a new text </s> <s>"))), (2, len(rows[0][1].encode()), len(coder.encode(rows[0][1])))])
    assert spark.read.parquet(cache).count() == stored + 1
    assert count(no_docs) == Counter()
    # an empty folder is an empty cache; what a broken append left isn't read
    path_of = tmp_path / "empty"
    broken = path_of / "_temporary" / "0" / "_temporary" / "attempt_1"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    cache = str(path_of)
    assert count(more) == Counter([(1, 19, len(coder.encode("a new text </s> <s>"))), (2, len(rows[0][1].encode()), len(coder.encode(rows[0][1])))])


def test_token_count_query_cold_and_warm(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sf, cache = "/root/testdata/sf0.001", str(tmp_path / "cache")
    coder = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    wanted = sorted((r.doc_id, len((r.text or "").encode()), n := len(coder.encode(r.text or "")), n > 4096) for r in docs)
    for _ in ("cold", "warm"):
        assert sorted(tuple(r) for r in QUERIES["op6_token_counts"](spark, sf, cache).collect()) == wanted
        assert spark.read.parquet(cache).count() == len({r.text or "" for r in docs})


@pytest.mark.parametrize("name", ["op7_toxicity", "op8_quality"])
def test_classifiers_on_held_out_labels(spark, name):
    sf = "/root/testdata/sf0.1"
    label = "toxic" if name == "op7_toxicity" else "quality"
    scored = QUERIES[name](spark, sf).toPandas()
    assert scored.score.between(0, 1).all() and len(scored) == 10_000
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    both = scored.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id").query("held_out")
    rank, y = both.score.rank(), both[label]
    n1 = y.sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert auc > 0.96
    assert (both.predicted == y).mean() > max(y.mean(), 1 - y.mean())


def test_classifiers_on_odd_rows(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (5, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    for module, op, column in ((toxicity, toxicity.toxicity, "toxic_score"), (quality, quality.quality, "quality_score")):
        assert {r[column] for r in op(docs, none).collect()} == {0.5}
        scored = op(docs.withColumn(column, F.lit("given")), some)
        assert [c for c in scored.columns if c in docs.columns] == docs.columns
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r[column] <= 1 for r in got)
        by_text = defaultdict(set)
        for r in got:
            by_text[r.text or ""].add(r[column])
        assert all(len(v) == 1 for v in by_text.values())  # equal texts, equal scores
        assert op(no_docs, some).count() == 0
        again = op(docs.repartition(2), some).collect()
        assert Counter((r.text, round(r[column], 6)) for r in got) == Counter((r.text, round(r[column], 6)) for r in again)


def test_temperature_of_scaled_logits():
    rng = np.random.default_rng(0)
    true = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    assert fit_scale(true * 3, y, np.ones(len(y))) == pytest.approx(3, rel=0.1)


def test_url_filters_follow_the_dates(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = spark.createDataFrame(
        [("bad.com", day(10), "spam"), ("bad.com", day(20), None), ("bad.com", day(30), "malware"), ("a.bad.com", day(15), "adult"), ("tie.org", day(5), "spam"), ("tie.org", day(5), None), (None, day(1), "spam"), ("never.org", None, "spam")],
        "key string, dated date, category string",
    )
    urls = [("http://bad.com/x", 9, None), ("http://bad.com/x", 10, "spam"), ("http://BAD.com:80/", 19, "spam"), ("https://u:p@www.bad.com?q", 20, None), ("http://bad.com", 35, "malware"), ("http://x.a.bad.com/", 16, "adult"), ("http://x.a.bad.com/", 12, "spam"), ("http://notbad.com/", 12, None), ("http://tie.org", 6, None), ("", 12, None), (None, 12, None), ("http://bad.com/", None, None), ("bad.com/", 12, None), ("http://bad.com/x", 10, "spam")]
    captures = spark.createDataFrame([(i, u, None if d is None else day(d), "x", "y") for i, (u, d, _) in enumerate(urls)], "page_id long, url string, fetched date, listed_key string, blocked string")
    got = {r.page_id: r.list_category for r in url_filter.url_filter(captures, entries).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(urls)}
    assert url_filter.url_filter(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.url_filter(captures, entries.limit(0)).collect())


def test_url_filters_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 0)
    test_url_filters_follow_the_dates(spark)


def language_truth(rows):
    docs = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    grams, uses = Counter(), Counter()
    for i, w in docs:
        if fold(i) != 2:
            uses.update([*w, "END"])
            grams.update(zip(["BEGIN", *w], [*w, "END"]))
    n, v = sum(uses.values()), len(uses)

    def discounts(counts):
        of = Counter(min(c, 5) for c in counts)
        return (0, *language_model.discounts([of[i] for i in (1, 2, 3, 4)]))

    d2, before = discounts(grams.values()), Counter(w for _, w in grams)
    d1, k = discounts(before.values()), len(grams)
    left = sum(d1[min(c, 3)] for c in before.values()) / k
    total, share = Counter(), defaultdict(float)
    for (u, _), c in grams.items():
        total[u] += c
        share[u] += d2[min(c, 3)]

    def p(u, w):
        single = max(before[w] - d1[min(before[w], 3)], 0) / k + left / (v + 1)
        c = grams[(u, w)]
        return max(c - d2[min(c, 3)], 0) / total[u] + share[u] / total[u] * single if total[u] else single

    assert sum(p("BEGIN", w) for w in uses) + p("BEGIN", "unknown") == pytest.approx(1)
    return Counter((i, fold(i) == 2, len(w) + 1, sum(uses[x] > 0 for x in [*w, "END"]), n, round(sum(math.log10((uses[x] + 1) / (n + v + 1)) for x in [*w, "END"]), 4), round(sum(math.log10(p(u, x)) for u, x in zip(["BEGIN", *w], [*w, "END"])), 4)) for i, w in docs)


def test_language_model(spark, docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(language_model, "COUNTED_TOKENS", 5_000)
    got = language_model.language_model(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == language_truth(rows)
    assert language_model.language_model(no_docs).count() == 0
    untrained = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert {(r.train_tokens, r.n_known, r.score) for r in language_model.language_model(untrained).collect()} == {(0, 0, 0.0)}


def test_language_model_over_hops(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(routing, "FAN", 2)
    monkeypatch.setattr(language_model, "n_parts", lambda *_: 6)
    monkeypatch.setattr(language_model, "COUNTED_TOKENS", 5_000)
    got = language_model.language_model(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == language_truth(rows)


def test_language_model_raises_where_an_array_is_missing(spark, tmp_path):
    texts = spark.createDataFrame([("a b c d",), ("a b x",)], "text string")
    model = language_model.train(texts, str(tmp_path))
    shard = sorted(model.gram_shards)[0]
    (tmp_path / f"gram-{shard}.npy").unlink()
    scored = language_model.score(spark.createDataFrame([(1, "a b c d a b x", False)], "doc_id long, text string, held_out boolean"), model)
    with pytest.raises(Exception, match="FileNotFound"):
        scored.collect()


def test_packed_columns_and_counts_beyond_32_bits():
    import zstandard

    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 2**64 - 1, 50, np.uint64), np.arange(50) + 2**33, np.zeros(0, np.int64), np.zeros(3, np.int64)]
    got = language_model._unpack(language_model._pack(columns, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
    assert all(np.array_equal(a.astype(np.uint64), b) for a, b in zip(columns, got, strict=True))
    routes = routing.plan_routes(1, 1)
    before, words, n = np.array([5, 5], np.uint64), np.array([8, 9], np.uint64), np.array([2**33, 1])
    twice = pa.concat_tables([language_model._gram_messages(routes, k, k, 1, 0, before, words, n) for k in (0, 1)])
    _, _, w, counts = language_model._grams(twice)
    assert dict(zip(w.tolist(), counts.tolist())) == {8: 2**34, 9: 2}


def test_language_model_needs_a_mounted_folder():
    assert language_model.local_path("file:///a%20b") == "/a b"
    with pytest.raises(ValueError):
        language_model.local_path("hdfs://x/y")


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.execute(SQL[name])
    columns = sorted(c[0] for c in wanted.description)
    found = QUERIES[name](spark, sf)
    assert sorted(found.columns) == columns
    order = [[c[0] for c in wanted.description].index(c) for c in columns]
    assert Counter(tuple(map(str, (r[c] for c in columns))) for r in found.collect()) == Counter(tuple(str(r[i]) for i in order) for r in wanted.fetchall())


def test_pipeline(spark):
    """Each stage's decisions hold on what the stage before it kept."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = docs.collect()
        assert {r.doc_id for r in after} <= set(before)
        assert all(r[c] == before[r.doc_id][c] for r in after for c in columns)
        assert docs.columns == columns or name == "mix"
        if name == "exact_dedup":
            bodies = lambda rows: [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in rows]
            assert len(after) == len(set(bodies(after))) and set(bodies(after)) == set(bodies(before.values()))
        if name == "near_dedup":
            from .test_dedup import near_truth

            assert {r.doc_id for r in after} == {i for i, _, c in near_truth([(r.doc_id, r.text) for r in before.values()], 5, 80) if i == c}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {r.doc_id for r in after} == {i for i, _, n, _ in decontamination_truth([(r.doc_id, r.text) for r in before.values()], items) if not n}
        if name == "mix":
            assert max(Counter(r.doc_id for r in after).values()) <= 2
            words = lambda rows: sum(len(SPACED.findall(r.text)) for r in rows)
            assert abs(words(after) - 1.5 * words(before.values())) < 0.1 * words(before.values())
    run = pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.mix_copy) for r in run.collect()) == Counter((r.doc_id, r.mix_copy) for r in docs.collect())


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """All labelled rows are dealt out and counted, none is left out for its rank or size, and parts' steps are averaged alike on reruns."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choice(words, 12), *(["vile"] if i % 3 == 0 else [])]), "en") for i in range(900)] + [(900, "long " * 900_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(901)], "doc_id long, toxic int")
    learnt = [i for i in range(901) if zlib.crc32(str(i).encode()) % 5]
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    dealt, n_parts, n_fit = toxicity._dealt(docs, labels)
    found = dealt.select("label_value", "checked", F.octet_length("ids").alias("n")).collect()
    assert n_parts > 1 and len(found) == len(learnt) and n_fit == sum(not r.checked for r in found)
    assert (max(r.n for r in found) == 4 * 900_000) == (900 in learnt)
    seen, sizes = toxicity._counts(dealt)
    assert sizes.sum() == n_fit and seen.sum(0).max() <= n_fit
    scores = [{r.doc_id: r.toxic_score for r in toxicity.toxicity(d, labels).collect()} for d in (docs, docs.repartition(5))]
    assert scores[0] == scores[1]
    assert np.mean([(scores[0][i] >= 0.5) == (i % 3 == 0) for i in range(900)]) > 0.95


def test_buckets_of_labelled_rows_travel_once(spark, monkeypatch):
    """Labels meet rows without buckets, and repeated ids and rows neither get lost nor multiply."""
    words = [f"w{i}" for i in range(40)]
    made = [(i, " ".join(random.Random(i).choices(words, k=30)), "en" if i % 3 else None) for i in range(400)] + [(7, "other text", "en"), (8, "twice", "de"), (8, "twice", "de"), (None, "x", "en"), (9000, "no label", "en")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(4, 0), (None, 1)], "doc_id long, toxic int")
    names = set()

    def joined(plan):
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            names.update(kid.output().apply(j).name() for kid in kids for j in range(kid.output().size()))
        for kid in kids:
            joined(kid)

    def noted(keep):
        def keeping(df, *kind):
            joined(df._jdf.queryExecution().optimizedPlan())
            return keep(df, *kind)

        return keeping

    monkeypatch.setattr(toxicity, "cut", noted(toxicity.cut))
    monkeypatch.setattr(toxicity, "stash", noted(toxicity.stash))
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    dealt, n_parts, n_fit = toxicity._dealt(docs, labels)
    assert "doc_id" in names and "ids" not in names
    got = dealt.collect()
    label = {i: i % 2 for i in range(400)}
    mine = Counter((4 * len(t.split()), lang, label[i]) for i, t, lang in made if i in label and zlib.crc32(str(i).encode()) % 5)
    assert Counter((len(r.ids), r.lang, r.label_value) for r in got) == mine
    assert n_fit == sum(not r.checked for r in got) and n_parts == 1 + n_fit // 100 > 1
    assert {r.part for r in got} <= set(range(n_parts))
    of = defaultdict(set)
    for r in got:
        of[bytes(r.ids), r.lang].add(r.part)
    assert all(len(x) == 1 for x in of.values())
