"""Key-value reads over the projected mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import kv
from slotscope.sources.tables import event_log, mutation_log

P = "p" + "0" * 17
LOG = "SELECT 'p' || lpad(l_partkey::VARCHAR, 20, '0') AS key, l_orderkey AS slot, l_linenumber AS seq, l_returnflag = 'R' AS is_delete, l_quantity AS value FROM lineitem"
SOURCES = ("slot % 3 = 0 OR slot % 5 = 0", "slot % 3 = 1", "slot % 3 = 2")
EVENTS = "SELECT 'u' || lpad(user_id::VARCHAR, 20, '0') AS key, event_id AS slot, 0 AS seq, event_type = 'error' AS is_delete, value, ts FROM events"


def cells(where: str = "true", log: str = LOG) -> str:
    """SQL of the resolved cells of a log's rows."""
    return f"SELECT key, slot, seq, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slot DESC, seq DESC, is_delete DESC, value DESC) AS nth FROM ({log}) WHERE {where}) WHERE nth = 1"


def live(where: str = "true", log: str = LOG) -> str:
    return f"SELECT key, slot, value FROM ({cells(where, log)}) WHERE NOT is_delete"


def kv_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(mutation_log(spark, sf_dir))


def kv_live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan_count(mutation_log(spark, sf_dir))


def kv_read_at_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(mutation_log(spark, sf_dir), as_of=4000)


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(mutation_log(spark, sf_dir), P + "042")


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(i, k) for i, k in enumerate([P + "007", P + "001", "missing", P + "150", P + "007"])], "ordinal long, key string")
    return kv.multi_get(mutation_log(spark, sf_dir), keys).select("ordinal", "key", "found", F.coalesce("slot", F.lit(-1)).alias("slot"), F.coalesce("value", F.lit(-1.0)).alias("value"))


def kv_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(mutation_log(spark, sf_dir), prefix=P, start_after=P + "010", end_key=P + "900", limit=25)


def kv_scan_exact_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(mutation_log(spark, sf_dir), prefix=P + "00", limit=100).select("key", "truncated")


def kv_scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(mutation_log(spark, sf_dir), prefix=P + "0", keys_only=True).select("key")


def kv_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan_count(mutation_log(spark, sf_dir), prefix=P, limit=100)


def kv_scan_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.byte_budget_page(mutation_log(spark, sf_dir), "p", budget=1000)


def kv_scan_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(mutation_log(spark, sf_dir), tombstones=True).drop("truncated")


def kv_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(mutation_log(spark, sf_dir)).groupBy(F.substring("key", 1, 20).alias("prefix")).agg(F.count("*").alias("n"))


def kv_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot is in one of three sources, and every fifth in the first as well."""
    log = mutation_log(spark, sf_dir)
    return kv.merge_sources([kv.resolve(log.where(w)) for w in SOURCES])


def kv_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = mutation_log(spark, sf_dir)
    found = kv.diff(kv.resolve(log, 2000), kv.resolve(log, 9000))
    return found.select("key", "kind", F.coalesce("left_slot", F.lit(-1)).alias("left_slot"), F.coalesce("right_slot", F.lit(-1)).alias("right_slot"))


def kv_event_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(event_log(spark, sf_dir))


def kv_reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.live(mutation_log(spark, sf_dir)).orderBy(F.desc("key")).limit(20)


QUERIES = {f.__name__: f for f in (kv_live, kv_live_count, kv_read_at_slot, kv_get, kv_multi_get, kv_scan_page, kv_scan_exact_fit, kv_scan_keys, kv_scan_count, kv_scan_byte_budget, kv_scan_tombstones, kv_prefix_count, kv_merge_sources, kv_snapshot_diff, kv_event_live, kv_reverse_scan)}

SQL = {
    "kv_live": live(),
    "kv_live_count": f"SELECT count(*) AS n FROM ({live()})",
    "kv_read_at_slot": live("slot <= 4000"),
    "kv_get": live(f"key = '{P}042'"),
    "kv_multi_get": f"WITH k(ordinal, key) AS (VALUES (0, '{P}007'), (1, '{P}001'), (2, 'missing'), (3, '{P}150'), (4, '{P}007')) SELECT k.ordinal::BIGINT AS ordinal, k.key, l.slot IS NOT NULL AS found, coalesce(l.slot, -1) AS slot, coalesce(l.value, -1.0) AS value FROM k LEFT JOIN ({live()}) l USING (key)",
    "kv_scan_page": f"WITH m AS (SELECT *, row_number() OVER (ORDER BY key) AS nth, count(*) OVER () AS n FROM ({live()}) WHERE starts_with(key, '{P}') AND key > '{P}010' AND key < '{P}900') SELECT key, slot, value, n > 25 AS truncated FROM m WHERE nth <= 25",
    "kv_scan_exact_fit": f"WITH m AS (SELECT *, row_number() OVER (ORDER BY key) AS nth, count(*) OVER () AS n FROM ({live()}) WHERE starts_with(key, '{P}00')) SELECT key, n > 100 AS truncated FROM m WHERE nth <= 100",
    "kv_scan_keys": f"SELECT key FROM ({live()}) WHERE starts_with(key, '{P}0')",
    "kv_scan_count": f"SELECT least(count(*), 100) AS n FROM ({live()}) WHERE starts_with(key, '{P}')",
    "kv_scan_byte_budget": f"WITH m AS (SELECT *, row_number() OVER (ORDER BY key) AS nth, sum(length(key) + length(value::VARCHAR)) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS bytes FROM ({live()})) SELECT key, slot, value, bytes::BIGINT AS bytes FROM m WHERE bytes <= 1000 OR nth = 1",
    "kv_scan_tombstones": f"SELECT key, slot, is_delete, value FROM ({cells()})",
    "kv_prefix_count": f"SELECT substr(key, 1, 20) AS prefix, count(*) AS n FROM ({live()}) GROUP BY 1",
    "kv_merge_sources": "WITH m AS (" + " UNION ALL ".join(f"SELECT key, slot, is_delete, value, {i} AS source FROM ({cells(w)})" for i, w in enumerate(SOURCES)) + ") SELECT key, slot, source, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slot DESC, source) AS nth FROM m) WHERE nth = 1",
    "kv_snapshot_diff": f"""SELECT key, kind, coalesce(ls, -1) AS left_slot, coalesce(rs, -1) AS right_slot FROM (
  SELECT key, ls, rs, CASE WHEN rs IS NULL THEN 'ONLY_LEFT' WHEN ls IS NULL THEN 'ONLY_RIGHT' WHEN ls <> rs THEN 'SLOT_DIFFERS' WHEN lv IS DISTINCT FROM rv OR ld IS DISTINCT FROM rd THEN 'VALUE_DIFFERS' END AS kind
  FROM (SELECT key, slot AS ls, is_delete AS ld, value AS lv FROM ({cells('slot <= 2000')})) FULL JOIN (SELECT key, slot AS rs, is_delete AS rd, value AS rv FROM ({cells('slot <= 9000')})) USING (key)
) WHERE kind IS NOT NULL""",
    "kv_event_live": live(log=EVENTS),
    "kv_reverse_scan": f"{live()} ORDER BY key DESC LIMIT 20",
}
