"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotscope.llm import bwt, exact_dedup, golomb, near_dedup, repeats, routing
from slotscope.llm.components import components

from .conftest import SCHEMA, make_rows

LAST = 2**63 - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200))
def test_golomb_codes_come_back(values):
    sorted_values = np.sort(np.array(values, np.uint64))
    assert np.array_equal(golomb.decode(golomb.encode(sorted_values)), sorted_values)
    owner = golomb.owners(sorted_values, 7)
    assert np.all(np.diff(owner) >= 0) and (not len(owner) or (owner.min() >= 0 and owner.max() < 7))


def exact_truth(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members), m[3] == keep, hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return Counter(out)


def test_exact_dedup(docs, no_docs, rows):
    got = exact_dedup.exact_dedup(docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact_truth(rows)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_over_many_blocks(docs, rows, monkeypatch):
    """Blocks of a few hundred bytes, so that copies meet across blocks."""
    import slotscope.llm.exact_dedup as module

    monkeypatch.setattr(module, "BLOCK_BYTES", 300)
    got = module.exact_dedup(docs.repartition(9))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact_truth(rows)


def test_keep_one_leaves_one_of_each_text_and_all_columns(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def near_truth(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, no_docs, rows, k, percent):
    got = near_dedup.near_duplicates(docs, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(rows, k, percent)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert near_dedup.near_duplicates(no_docs, k, percent).count() == 0


def test_near_dedup_of_a_large_group(spark):
    """Many near copies of one text, and many texts that share a passage but aren't alike."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = base.copy()
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(80)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(rows, 3, 85)


def test_near_dedup_of_a_dense_group_whose_members_barely_link(spark):
    """1,500 texts at 0.833 to each other; those of one first word are at 0.8505 and the only links."""
    rng = random.Random(11)
    base = [f"v{i}" for i in range(101)]
    rows = []
    for i in range(1500):
        words = base.copy()
        for k in (30, 60, 61, 100):
            words[k] = f"n{i}x{k}"
        words[0] = f"n{i % 1480}"
        rows.append((i, " ".join(words)))
    alike = lambda i, j: len(shingles(rows[i][1], 3) & shingles(rows[j][1], 3)) / len(shingles(rows[i][1], 3) | shingles(rows[j][1], 3))
    assert alike(0, 1480) > 0.85 > alike(0, 1) > 0.83
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1480 for i in range(1500)}


@settings(max_examples=40, deadline=None)
@given(*(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=6) for _ in range(2)), st.integers(1, 9))
def test_common_shingles(a, b, strip):
    whole, near_dedup.STRIP = near_dedup.STRIP, strip
    try:
        got = near_dedup.common_shingles(*([np.array(sorted(x), np.uint64) for x in side] for side in (a, b)))
    finally:
        near_dedup.STRIP = whole
    assert got.tolist() == [[len(x & y) for y in b] for x in a]


def test_keep_one_of_a_component(docs, rows):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    linked = [t for t in near_truth(rows, 5, 80).elements() if t[1]]
    # one row of each component; of rows without shingles, each
    assert sorted(x for x in got if x is not None) == sorted({i for i, _, c in linked if i == c and i is not None} | {r[0] for r in rows if not shingles(r[1], 5)})


def test_one_row_stays_of_null_ids_and_of_ids_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), "  ".join(words), " ".join(words[:-1])]
    for ids in ((None, None, None), (4, 4, 4)):
        docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(zip(ids, texts))] + [(ids[0], texts[0], 9)], "doc_id long, text string, other long")
        assert near_dedup.keep_one(docs).count() == 1
        assert exact_dedup.keep_one(docs).count() == 2


def order_rows(n, seed, bits):
    """Rows of sorted orders in which most are alike: few first MinHashes, and sketches a few bits apart; a third are of five components."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, near_dedup.HASHES)
    out = []
    for i in range(n):
        last = base ^ (rng.random(near_dedup.HASHES) < 0.05)
        prefix = np.array([rng.integers(0, 4), *rng.integers(0, 9, near_dedup.DEPTH - 1)], ">u4").tobytes()
        out.append((int(rng.integers(0, 2)), prefix, int(i).to_bytes(16, "big"), 100, near_dedup._sketch(last[None].astype(np.uint32), bits).tobytes(), bytes([i % 5]) * 16 if i % 3 == 0 else None))
    return sorted(out)


def test_sketches_agree_in_as_many_minhashes_as_share_their_last_bits():
    a, b = np.random.default_rng(5).integers(0, 1 << 32, (2, 40, near_dedup.HASHES), dtype=np.uint32)
    b[:20] = np.where(np.random.default_rng(6).random(b[:20].shape) < 0.8, a[:20], b[:20])
    for bits in (1, 4):
        x, y = (np.ascontiguousarray(near_dedup._sketch(s, bits)).view(np.uint64) for s in (a, b))
        assert near_dedup._unlike(x, y, bits).tolist() == ((a ^ b) % (1 << bits) > 0).sum(1).tolist()


@pytest.mark.parametrize("bits", [1, 4])
def test_neighbours_are_the_same_wherever_partitions_and_batches_end(spark, monkeypatch, bits):
    rows = order_rows(3000, 8, bits)
    root = {r[2]: r[5] for r in rows}

    def found(parts):
        df = spark.createDataFrame(rows, "tree int, prefix binary, node binary, n_shingles long, sketch binary, root binary")
        df = df.repartitionByRange(parts, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
        over = df.mapInArrow(near_dedup._edges, near_dedup.EDGES).groupBy("border").applyInArrow(near_dedup._over_border(85, 4, bits), near_dedup.PAIRS)
        near = df.mapInArrow(near_dedup._neighbours(85, 4, bits), near_dedup.PAIRS).unionByName(over)
        return {(bytes(r.x), bytes(r.y)) for r in near.collect()}

    whole = found(1)
    assert len(whole) > 3000
    assert not any(root[x] and root[x] == root[y] for x, y in whole)
    assert found(3) == found(8) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170")
    try:
        assert found(4) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("parts", [7])
def test_links_found_in_dense_groups_at_the_threshold(spark, parts):
    """Groups of many texts that differ from one text in few places: of all links, those within found components are 0.9 at least."""
    rng = random.Random(17)
    rows = []
    for g in range(4):
        base = [f"g{g}v{i}" for i in range(90)]
        for i in range(250):
            words = base.copy()
            for k in rng.sample(range(90), rng.choice((1, 2, 3))):
                words[k] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 3, 85).collect()
    component = {r.doc_id: r.component_id for r in got}
    sets = [shingles(t, 3) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i - i % 250, i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 1000
    assert sum(component[i] == component[j] for i, j in links) >= 0.9 * len(links)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(rows, 3, 85)


def test_candidates_of_a_dense_region_are_compared_in_blocks_and_not_confirmed_again(spark, monkeypatch):
    """Texts a little below the threshold: the second walk has many candidates among them and hardly a link."""
    rng = random.Random(23)
    base, rows = [f"v{i}" for i in range(90)], []
    for i in range(250):
        words = base.copy()
        for k in rng.sample(range(90), 2):
            words[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    confirmed, walks, confirm, stash = spark.sparkContext.accumulator(0), [], near_dedup._confirm, near_dedup.stash

    def counting(n_words, percent):
        inner = confirm(n_words, percent)

        def count(batches):
            def passed():
                for batch in batches:
                    confirmed.add(batch.num_rows)
                    yield batch

            yield from inner(passed())

        return count

    def noted(df, kind):
        out = stash(df, kind)
        if kind == "pairs":
            walks.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_confirm", counting)
    monkeypatch.setattr(near_dedup, "stash", noted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(rows, 3, 85)
    assert walks[1] > 2 * walks[0] > 0
    assert confirmed.value < walks[0] + walks[1] // 10


@pytest.mark.parametrize("edges_a_task", [16, 1 << 18])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr("slotscope.llm.components.EDGES_A_TASK", edges_a_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(1, 9)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=8), st.integers(2, 9))
def test_intervals_of_the_transform(texts, threshold):
    symbols = np.concatenate([np.concatenate([np.frombuffer(t, np.uint8).astype(np.uint16) + 1, [0]]) for t in texts]).astype(np.uint16)
    order = bwt.suffix_order(symbols, threshold)
    begins = bwt.prefix_boundaries(symbols, order, threshold)
    for a, b, begun in zip(order, order[1:], begins[1:]):
        x, y = symbols[a : a + threshold], symbols[b : b + threshold]
        same = len(x) == len(y) == threshold and np.array_equal(x, y) and bwt.SEPARATOR not in x
        assert begun == (not same)


def repeat_truth(rows, threshold):
    first = {}
    docs = [(LAST if i is None else i, (t or "").encode(), i) for i, t, *_ in rows]
    for i, b, _ in docs:
        for p in range(len(b) - threshold + 1):
            s = b[p : p + threshold]
            first[s] = min(first.get(s, LAST), i)
    out = Counter()
    for i, b, name in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if first[b[p : p + threshold]] < i:
                gone[p : p + threshold] = b"\1" * threshold
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[(name, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


def found_repeats(df, threshold=50):
    return Counter((r.doc_id, r.n_bytes, tuple((s["start"], s["end"]) for s in r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df, threshold).collect())


def test_repeats(docs, no_docs, rows):
    assert found_repeats(docs) == repeat_truth(rows, 50)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_with_small_sorts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SORTED_SYMBOLS", 500)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 700)
    other = make_rows(seed=9, n=40)
    assert found_repeats(spark.createDataFrame(other, SCHEMA).repartition(3)) == repeat_truth(other, 50)


def test_repeats_of_periodic_bytes(spark):
    rows = [(1, "ab" * 100), (2, "ba" * 60 + "tail"), (3, "\x00" * 120), (4, "é" * 70 + "\x00" * 49), (5, "é" * 30), (6, "\x00" * 50)]
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeat_truth(rows, 50)


def test_repeats_over_hops(spark, docs, rows, monkeypatch):
    """Many blocks and ranges, and a fan-out of two: strings and answers pass several hops."""
    monkeypatch.setattr(routing, "FAN", 2)
    monkeypatch.setattr(repeats, "n_parts", lambda *_: 6)
    assert routing.plan_routes(6, 6).levels == 3
    assert found_repeats(docs) == repeat_truth(rows, 50)


def test_repeats_around_a_hot_anchor(spark, monkeypatch):
    """A line that most documents have, with other words around it in each: its anchors' windows travel one by one."""
    rng = random.Random(4)
    line = "this line stands in very many of the documents, whoever wrote them, word for word"
    tail = lambda: " ".join(f"{rng.randrange(10**6)}" for _ in range(12))
    made = [(i, f"{tail()} {line if i % 3 else line[:44]} {tail()}") for i in range(120)] + [(500, line), (501, line * 2)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    wanted = repeat_truth(made, 50)
    monkeypatch.setattr(repeats, "n_parts", lambda *_: 5)
    monkeypatch.setattr(repeats, "HOT_STRINGS", 10)
    assert found_repeats(docs) == wanted
    monkeypatch.setattr(routing, "FAN", 3)
    assert found_repeats(docs) == wanted


def test_strings_of_one_hash_are_told_apart(monkeypatch):
    """Were all hashes of strings equal, strings would still be compared by their bytes."""
    texts = ["x" * 60, "y" * 60, "x" * 60, "z" * 50]
    block = repeats._Block.__new__(repeats._Block)
    block.data = np.frombuffer("".join(texts).encode(), np.uint8)
    block.first = np.array([0, 60, 120, 180])
    block.last = block.first + [10, 10, 10, 0]
    new = block._verified(np.array([True, False, False, False]), 50)
    string = np.cumsum(new) - 1
    got = [[bytes(block.data[block.first[i] : block.last[i] + 50]) for i in np.flatnonzero(string == s)] for s in range(string[-1] + 1)]
    assert all(len(set(g)) == 1 for g in got) and sum(map(len, got)) == 4


def test_strings_stand_in_one_order_however_messages_arrive():
    import pyarrow as pa
    import zstandard

    press, anchor = zstandard.ZstdCompressor(), np.full(3, 7 << 40, np.uint64)
    blobs = [repeats._pack(anchor, np.arange(3), np.full(3, 50), [bytes([65 + k + j]) * 50 for j in range(3)], press) for k in range(4)]
    tables = [pa.table({"sender": list(p), "to": [0] * 4, "part": [0] * 4, "blob": [blobs[k] for k in p]}) for p in ((0, 1, 2, 3), (3, 1, 0, 2))]
    a, b = (repeats._Strings(t) for t in tables)
    assert a.strings == b.strings and a.ids.tolist() == b.ids.tolist()
    assert [x.tolist() for x in a.sent] == [x.tolist() for x in b.sent]


def expanded(strings, ids, anchors):
    """What the owner of a range answers two senders, the strings dealt between them, as the smallest doc_id of each window."""
    import pyarrow as pa
    import zstandard

    press, sent = zstandard.ZstdCompressor(), [range(0, len(strings), 2), range(1, len(strings), 2)]
    blobs = [repeats._pack(np.array([anchors[i] for i in mine], np.uint64), np.array([ids[i] for i in mine]), np.array([len(strings[i]) for i in mine]), [strings[i] for i in mine], press) for mine in sent]
    told = repeats._expand(50)(pa.table({"sender": [0, 1], "to": [0, 0], "part": [0, 0], "blob": blobs}))
    got = {}
    for mine, reply in zip(sent, told.column("reply").to_pylist(), strict=True):
        runs = repeats._Runs.read([reply])
        for k, i in enumerate(mine):
            ends = runs.stops[runs.begins[k] : runs.begins[k] + runs.counts[k]]
            got[i] = np.repeat(runs.values[runs.begins[k] : runs.begins[k] + runs.counts[k]], np.diff(ends, prepend=0)).tolist()
    return [got[i] for i in range(len(strings))]


def windows_truth(strings, ids):
    least = defaultdict(lambda: LAST)
    for s, i in zip(strings, ids, strict=True):
        for p in range(len(s) - 49):
            least[s[p : p + 50]] = min(least[s[p : p + 50]], i)
    return [[least[s[p : p + 50]] for p in range(len(s) - 49)] for s in strings]


def met_strings():
    """Strings that have an anchor in common by chance, two that share windows, and one that is alone at its anchor."""
    common, rng = b"a phrase that many have in common", random.Random(8)
    strings = [b"%017d" % rng.randrange(10**17) + common + b"%017d" % rng.randrange(10**17) for _ in range(40)]
    strings += [b"x" + strings[7][:60], b"alone " * 11, b"ab" * 40, b"ba" * 30]
    return strings, [100 + rng.randrange(50) for _ in strings], [1 << 40] * 41 + [1 << 50] + [1 << 60] * 2


def test_strings_without_a_common_window_are_left_out_of_the_transform(monkeypatch):
    """Anchors that texts share by chance grow faster than the texts; their strings must not all be sorted."""
    strings, ids, anchors = met_strings()
    sorted_strings, smallest = [], repeats._smallest
    monkeypatch.setattr(repeats, "_smallest", lambda *a: sorted_strings.append(len(a[-2])) or smallest(*a))
    assert expanded(strings, ids, anchors) == windows_truth(strings, ids)
    assert 0 < sum(sorted_strings) <= 4


def test_a_passage_of_many_strings_is_transformed_once(monkeypatch):
    """Strings at the edge of a line that many documents have differ before it alone; what they share must not be sorted again for each."""
    rng, line = random.Random(3), b"a line of some sixty bytes that stands in all of the documents"
    strings = [b"%012d" % rng.randrange(10**12) + line for _ in range(200)] + [line[4:] + b" and more", line[2:58]]
    ids, anchors = [rng.randrange(1000) for _ in strings], [1 << 40] * len(strings)
    sorted_strings, smallest = [], repeats._smallest
    monkeypatch.setattr(repeats, "_smallest", lambda *a: sorted_strings.append(len(a[-2])) or smallest(*a))
    assert expanded(strings, ids, anchors) == windows_truth(strings, ids)
    assert sum(sorted_strings) < 120


def test_met_strings_of_one_hash_are_told_apart(monkeypatch):
    """Were the hashes of all strings at an anchor equal, equal ones and others would still get their windows' smallest doc_id."""
    strings, ids, anchors = met_strings()
    strings, ids, anchors = strings[:41] + strings[:41] + strings[41:], ids[:41] + [i - 3 for i in ids[:41]] + ids[41:], anchors[:41] * 2 + anchors[41:]
    monkeypatch.setattr(repeats, "_meeting", lambda anchors, hashes: anchors >> np.uint64(32) << np.uint64(32), raising=False)
    assert expanded(strings, ids, anchors) == windows_truth(strings, ids)


def test_repeats_around_a_hot_anchor_over_hops(spark, monkeypatch):
    rng = random.Random(6)
    line = "another line that stands in very many of the documents, whoever wrote them, word for word"
    tail = lambda: " ".join(f"{rng.randrange(10**6)}" for _ in range(12))
    made = [(i, f"{tail()} {line if i % 3 else line[:44]} {tail()}") for i in range(90)] + [(500, line), (501, line * 2)]
    monkeypatch.setattr(routing, "FAN", 2)
    monkeypatch.setattr(repeats, "n_parts", lambda *_: 9)
    monkeypatch.setattr(repeats, "HOT_STRINGS", 10)
    assert routing.plan_routes(9, 9 // 2, routing.FAN**2 // 32).levels == 2
    assert found_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(4)) == repeat_truth(made, 50)


def test_many_blocks_take_no_hop():
    """Blocks of 6 GB: a hop would unpack, merge and pack all strings once more, and once more on the way back."""
    assert routing.plan_routes(715, 715 // 2, routing.FAN**2 // 32) == routing.Routes(357, ())
    assert routing.plan_routes(60, 30, routing.FAN**2 // 32) == routing.plan_routes(60, 60) == routing.Routes(128, ())
    assert routing.plan_routes(3600, 1800, routing.FAN**2 // 32).levels == 2


def test_routes_nest_and_cover(monkeypatch):
    for fan, senders, ranges in ((128, 10, 5), (4, 50, 17), (3, 200, 100)):
        monkeypatch.setattr(routing, "FAN", fan)
        routes = routing.plan_routes(senders, ranges)
        assert routes.fan <= fan and routes.fan**routes.levels >= ranges
        values = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 500, np.uint64))
        for level in range(1, routes.levels + 1):
            part = golomb.owners(values, routes.fan**level)
            above = golomb.owners(values, routes.fan ** (level - 1))
            assert np.array_equal(part // routes.fan, above)
            for of in set(above.tolist()):
                mine = values[above == of]
                cuts = routes.cuts(mine, level, of)
                assert cuts[0] == 0 and cuts[-1] == len(mine)
