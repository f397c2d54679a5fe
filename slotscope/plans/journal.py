"""The journal over the projected mutation log, and snapshots of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import journal, kv, snapshot
from slotscope.functions.hashing import crc32c
from slotscope.plans.kv import LOG, P, cells, live
from slotscope.sources.folders import shared_folder
from slotscope.sources.tables import mutation_log, table


def journal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.journal_scan(mutation_log(spark, sf_dir), 1000, 3000, prefix=P + "0", limit=50)


def journal_exact_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's truncated differs from a scan's: a page that fits exactly is truncated."""
    return journal.journal_scan(mutation_log(spark, sf_dir), 1, 1).groupBy().agg(F.count("*").alias("n"), F.count_if("truncated").alias("n_truncated"))


def journal_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.frontier(mutation_log(spark, sf_dir))


def journal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.gaps(mutation_log(spark, sf_dir))


def journal_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.collect_garbage(kv.resolve(mutation_log(spark, sf_dir)), 12_000, 14_500).groupBy("is_delete").agg(F.count("*").alias("n"), F.min("slot").alias("min_slot"))


def wal_segment_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.segment_garbage(mutation_log(spark, sf_dir), 500, 7_499)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 5).alias("group_id"), (F.col("o_orderkey") % 3).alias("tenure"), F.floor(F.col("o_orderkey") / 300).cast("long").alias("round"), F.when(F.col("o_orderkey") % 997 != 0, F.floor(F.col("o_totalprice"))).cast("long").alias("applied"))


def safe_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.safe_slots(_reports(spark, sf_dir))


def snapshot_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("group_id"), (F.col("o_orderkey") % 3 == 0).alias("is_local"), (F.col("o_orderkey") % 4 > 0).alias("is_voter"), F.floor(F.col("o_totalprice")).cast("long").alias("durable"))
    return journal.snapshot_watermarks(o)


def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 10 == 0, "vote").when(F.col("o_orderkey") % 10 == 1, "promised").otherwise("accepted")
    segment = F.expr("o_orderkey div 1000")
    payload = F.encode(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "UTF-8")
    spoilt = (F.col("o_orderkey") % 109 == 0) & (segment % 2 == 1)  # in segments that aren't sealed
    records = o.select((F.col("o_custkey") % 20).alias("group_id"), segment.alias("segment"), F.col("o_orderkey").alias("position"), kind.alias("kind"), F.expr("o_orderkey div 400").alias("term"), F.col("o_orderkey").alias("slot"), (F.col("o_orderkey") % 3).alias("voted_for"), (segment % 2 == 0).alias("sealed"), payload.alias("payload"), spoilt.alias("spoilt"))
    stored = records.withColumn("checksum", crc32c("payload")).withColumn("payload", F.when(F.col("spoilt"), F.concat(F.col("payload"), F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("payload")))
    return journal.replay(journal.checked(stored)).withColumn("voted_for", F.coalesce("voted_for", F.lit(-1)))


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, listed and scanned; the folder is the shared one."""
    root, handle = shared_folder(spark, "snapshots"), "s1"
    snapshot.create(mutation_log(spark, sf_dir), root, handle, at_slot=9000, now_ms=1_000)
    assert snapshot.manifest(spark, root, now_ms=2_000).where(F.col("handle") == handle).count() == 1
    return snapshot.scan(spark, root, handle, prefix=P + "1", limit=60)


def snapshot_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot and the log after it give what the whole log gives."""
    root = shared_folder(spark, "snapshots")
    snapshot.create(mutation_log(spark, sf_dir), root, "s2", at_slot=7000, now_ms=1_000)
    return snapshot.with_tail(spark, root, "s2", 7000, mutation_log(spark, sf_dir)).where("NOT is_delete").select("key", "slot", "value")


QUERIES = {f.__name__: f for f in (journal_scan, journal_exact_fit, journal_frontier, journal_gaps, journal_gc, wal_segment_gc, safe_slot, snapshot_watermark, wal_replay, snapshot_scan, snapshot_with_tail)}

_SLOTS = "SELECT DISTINCT l_orderkey AS slot FROM lineitem"
_REPLAY = "SELECT o_custkey % 20 AS group_id, o_orderkey // 1000 AS segment, o_orderkey AS position, CASE o_orderkey % 10 WHEN 0 THEN 'vote' WHEN 1 THEN 'promised' ELSE 'accepted' END AS kind, o_orderkey // 400 AS term, o_orderkey AS slot, o_orderkey % 3 AS voted_for, NOT (o_orderkey % 109 = 0 AND o_orderkey // 1000 % 2 = 1) AS ok FROM orders"

SQL = {
    "journal_scan": f"WITH m AS (SELECT slot, seq, key, is_delete, value FROM ({LOG}) WHERE slot BETWEEN 1000 AND 3000 AND starts_with(key, '{P}0') ORDER BY slot, seq, key, is_delete, value LIMIT 50) SELECT *, (SELECT count(*) FROM m) >= 50 AS truncated FROM m",
    "journal_exact_fit": f"SELECT count(*) AS n, 0::BIGINT AS n_truncated FROM ({LOG}) WHERE slot = 1",
    "journal_frontier": f"WITH s AS (SELECT slot, row_number() OVER (ORDER BY slot) AS nth FROM ({_SLOTS}) WHERE slot >= 1) SELECT coalesce(max(slot) FILTER (slot = nth), 0) AS frontier, coalesce(max(slot), 0) AS tip FROM s",
    "journal_gaps": f"SELECT before + 1 AS first_missing, slot - 1 AS last_missing FROM (SELECT slot, coalesce(lag(slot) OVER (ORDER BY slot), 0) AS before FROM ({_SLOTS})) WHERE slot > before + 1",
    "journal_gc": f"SELECT is_delete, count(*) AS n, min(slot) AS min_slot FROM ({cells()}) WHERE NOT (is_delete AND slot <= 12000) GROUP BY 1",
    "wal_segment_gc": "SELECT l_orderkey // 500 AS segment, max(l_orderkey) AS max_slot, count(*) AS n_ops, max(l_orderkey) > 0 AND max(l_orderkey) < 7499 AS removed FROM lineitem GROUP BY 1",
    "safe_slot": "WITH m AS (SELECT o_custkey % 5 AS group_id, o_orderkey % 3 AS tenure, o_orderkey // 300 AS round, min(CASE WHEN o_orderkey % 997 <> 0 THEN floor(o_totalprice)::BIGINT ELSE 0 END) AS least FROM orders GROUP BY ALL) SELECT group_id, tenure, round, max(least) OVER (PARTITION BY group_id, tenure ORDER BY round ROWS UNBOUNDED PRECEDING) AS safe_slot FROM m",
    "snapshot_watermark": "SELECT o_custkey % 50 AS group_id, least(max(floor(o_totalprice)::BIGINT) FILTER (o_orderkey % 3 = 0), max(floor(o_totalprice)::BIGINT) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 > 0)) AS watermark FROM orders GROUP BY 1",
    "wal_replay": f"WITH r AS ({_REPLAY}), bad AS (SELECT group_id, segment, min(position) AS cut FROM r WHERE NOT ok GROUP BY 1, 2), g AS (SELECT r.*, max(term) OVER (PARTITION BY group_id) AS top FROM r LEFT JOIN bad USING (group_id, segment) WHERE cut IS NULL OR position < cut) SELECT group_id, max(term) AS term, count(*) AS n_records, max(slot) FILTER (kind = 'accepted') AS max_slot, coalesce(arg_max(voted_for, position) FILTER (kind = 'vote' AND term = top), -1) AS voted_for FROM g GROUP BY 1",
    "snapshot_scan": f"{live('slot <= 9000')} AND starts_with(key, '{P}1') ORDER BY key LIMIT 60",
    "snapshot_with_tail": live(),
}
