"""Bitmap reconciliation over block records that the lines make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import bitmap
from slotscope.sources.tables import block_records, table

CAPACITY = 1 << 31
#: Units that records may reach, for the integrity scan.
REACH = 120_000


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_records(spark, sf_dir).where("is_busy")


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_records(spark, sf_dir).where("NOT is_busy")


def bitmap_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.popcount(_busy(spark, sf_dir))


def bitmap_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.packed(_busy(spark, sf_dir)).groupBy("zone_id").agg(F.sum("used").alias("used"))


def bitmap_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference and symmetric difference of two views' bits, counted by zone."""
    return bitmap.set_operations(_busy(spark, sf_dir).where("stamp % 3 > 0"), _busy(spark, sf_dir).where("stamp % 3 < 2"))


def zone_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = block_records(spark, sf_dir)
    slots = records.select("zone_id").distinct().withColumn("snapshot_slot", F.lit(8000).cast("long"))
    found = bitmap.replayed(_busy(spark, sf_dir).where("stamp <= 8000"), records, slots)
    return found.groupBy("zone_id").agg(F.sum(bitmap.counted(F.col("mask"))).alias("used"), F.sum(bitmap.summed(F.col("word"), F.col("mask"))).alias("bits"))


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("zone_id"), (F.col("s_suppkey") * 100 % 9000).alias("compact_stamp"))


def zone_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_bits, stamps = bitmap.words(_busy(spark, sf_dir)), _stamps(spark, sf_dir)
    left, marks = bitmap.compact(set_bits, _free(spark, sf_dir), stamps)
    return bitmap.compacted_zones(set_bits, left, marks, stamps)


def ghost_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, replayed = block_records(spark, sf_dir).where("stamp % 5 > 0"), _busy(spark, sf_dir).where("stamp % 7 > 0")
    busy, free = _busy(spark, sf_dir).where("stamp % 11 > 2"), _free(spark, sf_dir).where("stamp % 2 = 0")
    return bitmap.ghosts(live, replayed, busy, free).groupBy("zone_id", "kind").agg(F.sum(bitmap.counted(F.col("mask"))).alias("n"))


def drift_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, replayed = _busy(spark, sf_dir), _busy(spark, sf_dir).where("NOT (zone_id % 4 = 1 AND stamp > 14000)")
    return bitmap.drift(live, replayed, table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("zone_id")))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.integrity(_zones(spark, sf_dir), block_records(spark, sf_dir).withColumn("owner", F.col("owner") % 50), REACH)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("zone_id"), F.encode("p_name", "UTF-8").alias("body"), F.crc32(F.encode(F.when(F.col("p_partkey") % 17 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")), "UTF-8")).alias("checksum"))


def integrity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.integrity_details(_zones(spark, sf_dir), block_records(spark, sf_dir).withColumn("owner", F.col("owner") % 50), REACH)


def zone_free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.free_runs(_busy(spark, sf_dir), CAPACITY)


def zone_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap.first_fit(bitmap.free_runs(_busy(spark, sf_dir), CAPACITY), 6)


QUERIES = {f.__name__: f for f in (bitmap_popcount, bitmap_packed, bitmap_set_ops, zone_replay, zone_compact, ghost_scan, drift_recalc, integrity, integrity_details, zone_free_runs, zone_first_fit)}

_R = "SELECT l_suppkey AS zone_id, (l_partkey * 64 + l_linenumber)::BIGINT AS unit_offset, (l_quantity % 4 + 1)::BIGINT AS unit_count, l_returnflag <> 'R' AS is_busy, l_orderkey AS stamp, l_partkey AS owner FROM lineitem"


def _bits(where: str) -> str:
    return f"SELECT DISTINCT zone_id, unnest(range(unit_offset, unit_offset + unit_count)) AS bit FROM ({_R}) WHERE {where}"


_RUNS = f"SELECT zone_id, before + 1 AS first, bit - before - 1 AS length FROM (SELECT zone_id, bit, coalesce(lag(bit) OVER (PARTITION BY zone_id ORDER BY bit), -1) AS before FROM (SELECT * FROM ({_bits('is_busy')}) UNION ALL SELECT DISTINCT zone_id, {CAPACITY}::BIGINT FROM ({_R}) WHERE is_busy)) WHERE bit > before + 1"
_STAMP = "SELECT s_suppkey AS zone_id, s_suppkey * 100 % 9000 AS compact_stamp FROM supplier WHERE s_suppkey % 5 > 0"

SQL = {
    "bitmap_popcount": f"SELECT zone_id, count(*) AS used FROM ({_bits('is_busy')}) GROUP BY 1",
    "bitmap_packed": f"SELECT zone_id, count(*) AS used FROM ({_bits('is_busy')}) GROUP BY 1",
    "bitmap_set_ops": f"WITH a AS ({_bits('is_busy AND stamp % 3 > 0')}), b AS ({_bits('is_busy AND stamp % 3 < 2')}), j AS (SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, a.bit AS x, b.bit AS y FROM a FULL JOIN b ON a.zone_id = b.zone_id AND a.bit = b.bit) SELECT zone_id, count(*) AS united, count(*) FILTER (y IS NULL) AS cleared, count(*) FILTER (x IS NULL OR y IS NULL) AS differ FROM j GROUP BY 1",
    "zone_replay": f"SELECT zone_id, count(*) AS used, sum(bit)::BIGINT AS bits FROM ({_bits('is_busy')}) GROUP BY 1",
    "zone_compact": f"WITH f AS (SELECT r.*, coalesce(compact_stamp, 0) AS c FROM ({_R}) r LEFT JOIN ({_STAMP}) USING (zone_id) WHERE NOT is_busy), gone AS (SELECT DISTINCT zone_id, unnest(range(unit_offset, unit_offset + unit_count)) AS bit FROM f WHERE stamp > c) SELECT zone_id, coalesce(used, 0) AS used, coalesce(fresh, 0) AS fresh, coalesce(stale, 0) AS stale, coalesce(s, compact_stamp, 0) AS compact_stamp FROM (SELECT DISTINCT zone_id FROM ({_R})) LEFT JOIN (SELECT zone_id, count(*) AS used FROM ({_bits('is_busy')}) b WHERE NOT EXISTS (FROM gone g WHERE g.zone_id = b.zone_id AND g.bit = b.bit) GROUP BY 1) USING (zone_id) LEFT JOIN (SELECT zone_id, count(*) FILTER (stamp > c) AS fresh, count(*) FILTER (stamp <= c) AS stale, greatest(max(stamp), max(c)) AS s FROM f GROUP BY 1) USING (zone_id) LEFT JOIN ({_STAMP}) USING (zone_id)",
    "ghost_scan": f"WITH l AS ({_bits('stamp % 5 > 0')}), r AS ({_bits('is_busy AND stamp % 7 > 0')}), b AS ({_bits('is_busy AND stamp % 11 > 2')}), f AS ({_bits('NOT is_busy AND stamp % 2 = 0')}), d AS (SELECT coalesce(l.zone_id, r.zone_id) AS zone_id, coalesce(l.bit, r.bit) AS bit, l.bit IS NOT NULL AS is_live FROM l FULL JOIN r ON l.zone_id = r.zone_id AND l.bit = r.bit WHERE l.bit IS NULL OR r.bit IS NULL), k AS (SELECT d.zone_id, CASE WHEN is_live AND b.bit IS NULL AND f.bit IS NULL THEN 'ghost_busy' WHEN is_live AND b.bit IS NULL THEN 'uncompacted_lag' WHEN NOT is_live AND b.bit IS NOT NULL THEN 'ghost_free' END AS kind FROM d LEFT JOIN b ON d.zone_id = b.zone_id AND d.bit = b.bit LEFT JOIN f ON d.zone_id = f.zone_id AND d.bit = f.bit) SELECT zone_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2",
    "drift_recalc": f"SELECT zone_id, coalesce(a, 0) AS live, coalesce(b, 0) AS replayed, zone_id % 10 = 0 OR coalesce(a, 0) <> coalesce(b, 0) AS drifts FROM (SELECT zone_id, count(*) AS a FROM ({_bits('is_busy')}) GROUP BY 1) FULL JOIN (SELECT zone_id, count(*) AS b FROM ({_bits('is_busy AND NOT (zone_id % 4 = 1 AND stamp > 14000)')}) GROUP BY 1) USING (zone_id)",
    "integrity": f"SELECT (SELECT count(*) FROM part WHERE p_partkey % 17 = 0) AS corrupt_snapshots, count(*) FILTER (unit_count <= 0 OR unit_offset + unit_count > {REACH}) AS corrupt_records, count(*) FILTER (owner % 50 = 0) AS zero_owner FROM ({_R})",
    "integrity_details": f"SELECT * FROM (SELECT 'corrupt_snapshot' AS kind, p_partkey AS zone_id, -1::BIGINT AS unit_offset FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT 'corrupt_record', zone_id, unit_offset FROM ({_R}) WHERE unit_count <= 0 OR unit_offset + unit_count > {REACH} UNION ALL SELECT 'zero_owner', zone_id, unit_offset FROM ({_R}) WHERE owner % 50 = 0) ORDER BY kind, zone_id, unit_offset LIMIT 256",
    "zone_free_runs": _RUNS,
    "zone_first_fit": f"SELECT zone_id, min(first) AS unit_offset FROM ({_RUNS}) WHERE length >= 6 GROUP BY 1",
}
