"""Semantics of the versioned log, and functions with known answers."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotscope.functions import erasure, hashing, keys
from slotscope.operators import bitmap, chunk, journal, kv, metrics, placement, snapshot, space
from slotscope.sources import log as log_table
from slotscope.streaming.watch import check_applied, first_seen, guard, on_time

LOG = "key string, slot long, seq int, is_delete boolean, value long"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_random_operations_match_a_dictionary(spark):
    rng = random.Random(2024)
    rows, state, slot = [], {}, 0
    while len(rows) < 20_000:
        slot += 1
        for seq in range(rng.randint(2, 6) if rng.random() < 0.1 else 1):
            key, gone = f"k{rng.randrange(120):03d}", rng.random() < 0.25
            value = rng.randrange(10**6)
            rows.append((key, slot, seq, gone, None if gone else value))
            state[key] = None if gone else value
    rng.shuffle(rows)  # the order of arrival decides nothing
    found = {r.key: r.value for r in kv.live(log(spark, *rows)).collect()}
    assert found == {k: v for k, v in state.items() if v is not None}


def test_deletes_hide_after_versions_are_resolved(spark):
    rows = log(spark, ("a", 1, 0, False, 10), ("a", 2, 0, True, None), ("b", 1, 0, True, None), ("b", 3, 0, False, 5), ("c", 4, 0, False, 1), ("c", 4, 1, False, 2))
    assert {(r.key, r.value) for r in kv.live(rows).collect()} == {("b", 5), ("c", 2)}
    assert {(r.key, r.value) for r in kv.live(rows, as_of=1).collect()} == {("a", 10)}
    assert {r.key for r in kv.scan(rows, tombstones=True).collect()} == {"a", "b", "c"}
    assert kv.get(rows, "a").count() == 0


@pytest.mark.parametrize(("limit", "truncated"), [(2, True), (3, False), (4, False)])
def test_a_page_that_fits_exactly_is_not_truncated(spark, limit, truncated):
    rows = log(spark, *((k, i, 0, False, i) for i, k in enumerate("abc")))
    page = kv.scan(rows, limit=limit).collect()
    assert len(page) == min(limit, 3)
    assert {r.truncated for r in page} == {truncated}


def test_journal_is_truncated_once_the_limit_is_reached_and_its_cursor_loses_nothing(spark):
    rows = log(spark, *((f"k{i}", 1 + i // 3, i % 3, False, i) for i in range(9)))
    page = journal.journal_scan(rows, 1, limit=4).collect()
    assert len(page) == 4 and all(r.truncated for r in page)
    rest = journal.journal_scan(rows, 1, after=(page[-1].slot, page[-1].seq)).collect()
    assert sorted(r.value for r in page + rest) == list(range(9))
    assert all(r.truncated for r in journal.journal_scan(rows, 1, limit=9).collect())
    with pytest.raises(journal.GapError):
        journal.journal_scan(rows, 1, trim_slot=2)


def test_scan_bounds_are_exclusive_and_budgets_keep_the_first_row(spark):
    rows = log(spark, *((k, i, 0, False, i) for i, k in enumerate(["a", "ab", "abc", "b"])))
    assert [r.key for r in kv.scan(rows, prefix="a", start_after="a", end_key="abc").collect()] == ["ab"]
    assert [r.key for r in kv.byte_budget_page(rows, "", budget=1).collect()] == ["a"]
    assert [r.key for r in kv.byte_budget_page(rows, "", budget=5).collect()] == ["a", "ab"]


def test_diff_reports_slots_before_values(spark):
    left = kv.resolve(log(spark, ("a", 1, 0, False, 1), ("b", 1, 0, False, 1), ("c", 1, 0, False, 1), ("d", 1, 0, True, None)))
    right = kv.resolve(log(spark, ("b", 2, 0, False, 9), ("c", 1, 0, False, 2), ("d", 1, 0, True, None), ("e", 1, 0, False, 1)))
    assert {(r.key, r.kind) for r in kv.diff(left, right).collect()} == {("a", "ONLY_LEFT"), ("b", "SLOT_DIFFERS"), ("c", "VALUE_DIFFERS"), ("e", "ONLY_RIGHT")}


@pytest.mark.parametrize("width", [2, 1 << 14])
def test_frontier_and_gaps(spark, width):
    rows = log(spark, *((f"k{s}", s, 0, False, s) for s in (1, 2, 3, 5, 6, 9)))
    assert tuple(journal.frontier(rows, width).first()) == (3, 9)
    assert sorted(tuple(r) for r in journal.gaps(rows, width).collect()) == [(4, 4), (7, 8)]
    assert tuple(journal.frontier(rows.where("slot < 4"), width).first()) == (3, 3)
    assert tuple(journal.frontier(rows.where("slot > 1"), width).first()) == (0, 9)
    assert tuple(journal.frontier(rows.limit(0), width).first()) == (0, 0)


def test_snapshots_hold_while_the_log_goes_on(spark, tmp_path):
    rows = log(spark, ("a", 1, 0, False, 1), ("b", 2, 0, True, None), ("a", 3, 0, False, 2))
    snapshot.create(rows, str(tmp_path), "s", at_slot=2, now_ms=0, lease_ms=100)
    assert [(r.key, r.value) for r in snapshot.scan(spark, str(tmp_path), "s").collect()] == [("a", 1)]
    assert snapshot.manifest(spark, str(tmp_path), now_ms=99).count() == 1
    assert snapshot.manifest(spark, str(tmp_path), now_ms=100).count() == 0
    assert {(r.key, r.value) for r in snapshot.with_tail(spark, str(tmp_path), "s", 2, rows).where("NOT is_delete").collect()} == {("a", 2)}
    snapshot.release(spark, str(tmp_path), "s")
    assert not (tmp_path / "cells" / "s").exists()


def test_fixed_histogram_target_of_zero_is_the_first_bound(spark):
    one = spark.createDataFrame([("get", 400)], "op string, micros long")
    r = metrics.fixed_histogram(one).first()
    assert (r.n, r.p50, r.p99, r.max_bound) == (1, 1, 1, 500)


def test_precise_histogram_matches_its_formula(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 3000, 500), rng.integers(1, 1 << 40, 500)])
    r = metrics.precise_histogram(spark.createDataFrame([("x", int(v)) for v in values], "op string, micros long")).first()
    clamped = np.sort(np.clip(values, 1, metrics.LARGEST))
    shift = np.maximum(0, np.array([int(v).bit_length() for v in clamped]) - 11)
    parts = (clamped >> shift) << shift
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p99_9")):
        assert r[name] == parts[max(1, int(np.ceil(q * 1000))) - 1]
    assert (r["min"], r["max"]) == (clamped[0], clamped[-1])


def test_xxh64_and_splitmix64_known_answers():
    ids = [(0, 0), (1, 2), (2**64 - 1, 12345678901234567890)]
    got = hashing.xxh64_of_16(np.array([h for h, _ in ids], np.uint64), np.array([low for _, low in ids], np.uint64))
    assert got.tolist() == [xxhash.xxh64_intdigest(h.to_bytes(8, "big") + low.to_bytes(8, "big"), 0) for h, low in ids]
    assert hashing.splitmix64(np.array([0], np.uint64))[0] == 0xE220A8397B1DCDAF
    assert list(hashing.value_bytes(7, 3)) == [int(hashing.splitmix64(np.uint64(7) ^ hashing.splitmix64(np.array([i], np.uint64)))[0]) & 255 for i in range(3)]


def test_size_mix_must_make_a_hundred():
    with pytest.raises(ValueError):
        hashing.mixed_size(None, ((64, 50), (128, 49)))


@pytest.mark.parametrize("length", [0, 1, 7, 64, 1000])
def test_any_loss_of_m_shards_is_repaired(length):
    import itertools

    data = bytes(np.random.default_rng(length).integers(0, 256, length, dtype=np.uint8))
    shards = erasure.encode(data, 4, 2)
    assert len({len(s) for s in shards}) == 1
    for lost in itertools.combinations(range(6), 2):
        assert erasure.decode([None if i in lost else s for i, s in enumerate(shards)], 4, 2, length) == data
    with pytest.raises(ValueError):
        erasure.decode([None, None, None, *shards[3:]], 4, 2, length)


def test_bounded_deduplication_forgets_in_order_and_keeps_places():
    window, new = first_seen([], [1, 2, 1])
    assert (window, new) == ([1, 2], [True, True, False])
    window, _ = first_seen([], list(range(64)))
    window, new = first_seen(window, [0, 64, 0])  # meeting 0 again doesn't refresh it, so 64 pushes it out
    assert new == [False, True, True]


def test_late_writes_and_reads_ahead(spark):
    rows = log(spark, ("a", 5, 0, False, 1), ("a", 6, 0, False, 2))
    assert on_time(rows, 5).count() == 1 and on_time(rows, 5, allow_old=True).count() == 2
    check_applied(5, 5)
    with pytest.raises(ValueError):
        check_applied(4, 5)


def test_batch_payloads_stop_at_what_is_malformed():
    whole = b"\x02\x00" + b"\x00\x01\x00\x00\x00k\x01\x00\x00\x00v" + b"\x01\x01\x00\x00\x00k\x00\x00\x00\x00"
    assert keys._operations(whole) == [(0, False, b"k", b"v"), (1, True, b"k", b"")]
    for cut in range(len(whole)):
        assert keys._operations(whole[:cut]) == [(0, False, b"k", b"v"), (1, True, b"k", b"")][: (cut >= 13)]
    assert keys._operations(None) == []


def test_ranges_cover_all_buckets_and_follow_the_instances(spark):
    for n in (1, 2, 3):
        ranges = space.assign_ranges(spark.range(n).withColumnRenamed("id", "instance_id"), 16).orderBy("start").collect()
        assert ranges[0].start == 0 and ranges[-1].end == 65535
        assert all(a.end + 1 == b.start for a, b in zip(ranges, ranges[1:]))
        assert len({r.instance_id for r in ranges}) == n


def test_mirrors_are_on_different_nodes_and_spread_over_racks(spark):
    groups = spark.createDataFrame([(10 * n + k, n, n % 3) for n in range(9) for k in range(2)], "dg_id long, node_id long, rack_id long")
    found = placement.mirror(spark.range(20).withColumnRenamed("id", "request"), groups, 3).collect()
    for request in range(20):
        mine = [r for r in found if r.request == request]
        assert len({r.node_id for r in mine}) == 3 and len({r.rack_id for r in mine}) == 3


def test_safe_erasure_coding_limits_blocks_of_a_node(spark):
    groups = spark.createDataFrame([(10 * n + k, n) for n in range(4) for k in range(3)], "dg_id long, node_id long")
    found = placement.erasure_coded(spark.range(10).withColumnRenamed("id", "request"), groups, 6, 2).collect()
    for request in range(10):
        mine = [r for r in found if r.request == request]
        assert len({r.dg_id for r in mine}) == 8
        assert max(Counter(r.node_id for r in mine).values()) <= 2
    none = placement.erasure_coded(spark.range(1).withColumnRenamed("id", "request"), groups.where("node_id < 3"), 6, 2).collect()
    assert [r.block for r in none] == [-1]


def test_allocation_rotates_and_reports_no_room(spark):
    rows = spark.createDataFrame([(1, i, u) for i, u in enumerate([4, 4, 3, 4, 1])], "zone_id long, at long, units long")
    assert [r.unit_offset for r in placement.allocate(rows, 12).orderBy("at").collect()] == [0, 4, 8, -1, 11]


def test_bitmaps_keep_zones_that_one_side_lacks(spark):
    """Zone 1 has bits on both sides; zone 2 is empty in the snapshot, zone 3 has no frees, zone 4 is emptied by compaction."""
    records = spark.createDataFrame([(1, 0, 2, True, 5), (1, 8, 1, True, 20), (2, 3, 2, True, 30), (2, 9, 1, False, 31)], "zone_id long, unit_offset long, unit_count long, is_busy boolean, stamp long")
    slots = spark.createDataFrame([(1, 10), (2, 10)], "zone_id long, snapshot_slot long")
    at = bitmap.bits(records.where("is_busy AND stamp <= 10")).withColumn("snapshot_slot", F.lit(10).cast("long"))
    assert {tuple(r) for r in bitmap.replay(at, records, slots).select("zone_id", "bit").collect()} == {(1, 0), (1, 1), (1, 8), (2, 3), (2, 4)}

    bits = lambda *rows: spark.createDataFrame(list(rows), "zone_id long, bit long")
    held, stamps = bits((1, 0), (1, 1), (3, 0), (4, 0)), spark.createDataFrame([(3, 7)], "zone_id long, compact_stamp long")
    freed = spark.createDataFrame([(1, 0, 1, 9), (4, 0, 1, 8)], "zone_id long, unit_offset long, unit_count long, stamp long")
    left, marks = bitmap.compact(held, freed, stamps)
    assert {tuple(r) for r in bitmap.compacted_zones(held, left, marks, stamps).collect()} == {(1, 1, 1, 0, 9), (3, 1, 0, 0, 7), (4, 0, 1, 0, 8)}

    found = bitmap.set_operations(bits((1, 0), (1, 1), (2, 5), (3, 6)), bits((1, 1), (2, 5), (4, 7)))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 1, 1), (2, 1, 0, 0), (3, 1, 1, 1), (4, 1, 0, 1)}


def test_crc32c_known_answers_and_values_of_one_length():
    assert hashing.crc32c_of([b"123456789", b"", None, b"\0" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0, 0, 0x8A9136AA, 0x62A8AB43]
    keys_ = np.array([7, 9, 2**63], np.uint64)
    assert [v.tobytes() for v in hashing.values_of(keys_, 5)] == [hashing.value_bytes(int(k), 5).tobytes() for k in keys_]


RECORD = "group_id long, segment long, position long, kind string, term long, slot long, voted_for long, sealed boolean, ok boolean"


def test_replay_cuts_a_tail_and_refuses_a_corrupt_sealed_segment(spark):
    rows = [(1, 1, 1, "accepted", 1, 5, None, True, True), (1, 2, 2, "vote", 2, 0, 8, False, True), (1, 2, 3, "accepted", 9, 7, None, False, False), (1, 2, 4, "accepted", 3, 6, None, False, True), (1, 3, 5, "accepted", 2, 9, None, True, True), (1, 3, 6, "vote", 2, 0, 4, True, True), (1, 3, 7, "accepted", 4, 8, None, True, False)]
    records = spark.createDataFrame(rows, RECORD)
    # of segment 2 the tail from its bad record on is cut, of the last segment too although it is sealed
    assert [tuple(r) for r in journal.replay(records).collect()] == [(1, 2, 4, 9, 4)]
    broken = records.withColumn("ok", F.col("position") != 1)
    with pytest.raises(Exception, match="sealed segment 1 of group 1"):
        journal.replay(broken).collect()
    stored = spark.createDataFrame([(b"abc", int(hashing.crc32c_of([b"abc"])[0])), (b"abd", int(hashing.crc32c_of([b"abc"])[0]))], "payload binary, checksum long")
    assert [r.ok for r in journal.checked(stored).collect()] == [True, False]


def test_blocks_of_a_request_are_on_different_disks_or_none_is_placed(spark):
    disks = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "dg_id long, disk_no long")
    requests = spark.createDataFrame([(1, 1, 4, 2), (1, 2, 4, 3), (1, 3, 4, 4), (1, 4, 4, 1), (2, 1, 1, 1), (1, 5, 4, 3), (1, 6, 4, 1), (1, 7, 4, 3), (1, 8, 2, 1)], "dg_id long, at long, units long, n long")
    found = {(r.dg_id, r.at): [] for r in requests.collect()}
    for r in placement.allocate_blocks(requests, disks, zones_each=1, capacity=12).orderBy("dg_id", "at", "nth").collect():
        found[(r.dg_id, r.at)].append((r.nth, r.disk_no, r.unit_offset))
    assert [len(found[(1, at)]) for at in (1, 2, 4, 6)] == [2, 3, 1, 1]
    # more blocks than disks; no disk; the first disk is full by then
    assert found[(1, 3)] == found[(2, 1)] == found[(1, 5)] == [(-1, -1, -1)]
    for mine in found.values():
        assert len({d for _, d, _ in mine}) == len(mine)
    # what failed gave its units back
    assert found[(1, 6)][0][0] == found[(1, 8)][0][0] == 0
    taken = [(d, o) for mine in found.values() for n, d, o in mine if n >= 0]
    assert len(taken) == len(set(taken))


def test_commits_gather_writes(spark, tmp_path):
    path = str(tmp_path / "log")
    with log_table.Commit(spark, path) as commit:
        commit.put(1, "a", 1.0)
        commit.put(1, "a", 2.0)
        commit.delete(2, "b")
    assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("part")]) <= 4
    assert {(r.key, r.slot, r.value) for r in kv.live(log_table.read(spark, path)).collect()} == {("a", 1, 2.0)}
    with pytest.raises(RuntimeError):
        with log_table.Commit(spark, path) as commit:
            commit.put(3, "c", 1.0)
            raise RuntimeError
    assert log_table.read(spark, path).count() == 3


def test_pages_are_those_of_a_cursor(spark, tmp_path):
    rows = log(spark, *((f"k{i:03d}", i, 0, i % 7 == 0, i) for i in range(95)))
    got = {r.key: r.page for r in kv.pages(rows.repartition(6), 10, str(tmp_path / "pages")).collect()}
    wanted, after, n = {}, None, 0
    while True:
        page = kv.scan(rows, start_after=after, limit=10).orderBy("key").collect()
        wanted |= {r.key: n for r in page}
        if not page[-1].truncated:
            break
        after, n = page[-1].key, n + 1
    assert got == wanted


def test_a_guarded_stream_refuses_what_is_below_its_floor(spark, tmp_path):
    source = tmp_path / "in"
    for i, slots in enumerate(([5, 11, 20], [12, 16, 30], [19, 20, 31])):
        spark.createDataFrame([(s, i) for s in slots], "slot long, value long").coalesce(1).write.mode("append").parquet(str(source / f"f{i}"))
    stream = spark.readStream.schema("slot long, value long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    accepted, late = guard(stream, 10, 5, str(tmp_path / "out"))
    # the floor is 10, then 15, then 25
    assert sorted(r.slot for r in accepted.collect()) == [11, 16, 20, 30, 31]
    assert sorted(r.slot for r in late.collect()) == [5, 12, 19, 20]


def test_configs_of_any_depth(spark):
    flat = chunk.flatten_config(spark.createDataFrame([(1, '{"a": {"b": {"c": 1}, "d": [1, 2]}, "e": "x", "f": {}}'), (2, "{}")], "id long, config string"), "id", "config")
    assert {tuple(r) for r in flat.collect()} == {(1, "a.b.c", "1"), (1, "a.d", "[1,2]"), (1, "e", "x")}


def test_without_instances_bindings_stay(spark):
    now = spark.createDataFrame([(0, 3, False), (1, 4, True)], "sub_range long, instance_id long, in_transition boolean")
    none = now.where("sub_range < 0").select("sub_range", "instance_id")
    assert {tuple(r) for r in space.binding_changes(none, now).collect()} == {(0, 3, "keep"), (1, 4, "keep")}


def test_words_of_bits_equal_sets_of_bits_and_are_few(spark):
    """Records over borders of words and strips, one without units; the rows that are grouped are words, not bits."""
    rng = random.Random(5)
    rows = [(z, rng.randrange(200_000) * (z > 0), rng.choice([0, 1, 4, 64, 65, 200]), rng.random() < 0.7) for z in range(4) for _ in range(60)] + [(9, 64, 64, True), (9, 127, 2, True)]
    records = spark.createDataFrame(rows, "zone_id long, unit_offset long, unit_count long, is_busy boolean")
    held = lambda keep: {(z, b) for z, o, n, busy in rows if keep(z, o, busy) for b in range(o, o + n)}
    a, b = held(lambda z, o, busy: busy), held(lambda z, o, busy: o % 3 > 0)
    assert {tuple(r) for r in bitmap.bits(records.where("is_busy")).collect()} == a
    found = {r.zone_id: (r.united, r.cleared, r.differ) for r in bitmap.set_operations(records.where("is_busy"), records.where("unit_offset % 3 > 0")).collect()}
    by_zone = lambda bits: Counter(z for z, _ in bits)
    assert found == {z: (by_zone(a | b)[z], by_zone(a - b)[z], by_zone(a ^ b)[z]) for z, _ in a | b}
    grouped = bitmap.words(records.where("is_busy"))
    assert {r.zone_id: r.s for r in grouped.groupBy("zone_id").agg(F.sum(bitmap.summed(F.col("word"), F.col("mask"))).alias("s")).collect()} == {z: sum(x for y, x in a if y == z) for z, _ in a}
    assert grouped.count() == len({(z, x // 64) for z, x in a})
    assert {(r.zone_id, r.stretch): r.used for r in bitmap.packed(records.where("is_busy")).collect()} == Counter((z, x // 32768) for z, x in a)
    runs = {(r.zone_id, i) for r in bitmap.free_runs(records.where("is_busy"), 250_000).collect() for i in range(r.first, r.first + r.length)}
    assert runs == {(z, i) for z in {z for z, _ in a} for i in range(250_000) if (z, i) not in a}


def test_mirror_rows_do_not_carry_the_topology(spark):
    """Fewer racks than copies: turns go round, and a request's row is as small with many groups as with few."""
    groups = spark.createDataFrame([(100 * n + k, n, n % 2) for n in range(6) for k in range(50)], "dg_id long, node_id long, rack_id long")
    found = placement.mirror(spark.range(40).withColumnRenamed("id", "request"), groups, 3)
    assert "array" not in " ".join(kind for _, kind in found.dtypes) and "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == 120 and all(r.dg_id // 100 == r.node_id and r.node_id % 2 == r.rack_id for r in rows)
    for request in range(40):
        mine = sorted((r.nth, r.node_id) for r in rows if r.request == request)
        assert [nth for nth, _ in mine] == [1, 2, 3] and len({node for _, node in mine}) == 3
    assert placement.mirror(spark.range(3).withColumnRenamed("id", "request"), groups.limit(0), 3).count() == 0
