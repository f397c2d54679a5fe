"""Writes and pages of the log, and the fleet: replicas, topology, endpoints, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import fleet, kv
from slotscope.plans.kv import live
from slotscope.sources import log
from slotscope.sources.folders import shared_folder
from slotscope.sources.tables import block_records, dg_usage_rows, disk_groups, mutation_log, nodes, racks, table


def kv_write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of the mutation log, then a put and a delete in a third; the live table of what was written."""
    path, rows = shared_folder(spark, "log"), mutation_log(spark, sf_dir)
    log.append(rows.where("slot <= 7000"), path)
    log.append(rows.where("slot > 7000"), path)
    with log.Commit(spark, path) as commit:
        commit.put(20_000_001, "a new key", 1.5)
        commit.delete(20_000_002, "p" + "0" * 17 + "042")
    return kv.live(log.read(spark, path))


def kv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 1,000 keys of one pinned state."""
    return kv.pages(mutation_log(spark, sf_dir), 1000, shared_folder(spark, "pages"), as_of=14_000)


def sysdata_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").select(F.concat(F.lit("/sys/"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("value"))
    return log.decode_records(records, "k long").groupBy("k").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def operations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read again."""
    path = shared_folder(spark, "operations")
    log.write_operations(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    return spark.read.schema("event_id long, user_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select((c % 20).alias("store_id"), (c % 300).alias("group_id"), (o % 5).alias("replica_id"), (o % 9).alias("node_id"))


def replica_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.replica_views(_reports(spark, sf_dir))


def replica_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    found = fleet.reconcile_replicas(r.where("node_id < 6").drop("node_id").distinct(), r.where("node_id > 3").drop("node_id").distinct())
    return found.groupBy("store_id", "action").agg(F.count("*").alias("n"))


def topology_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their leaders' endpoints, and evicted groups with none."""
    o = table(spark, sf_dir, "orders")
    fresh = o.where("o_custkey % 4 > 0").select((F.col("o_custkey") % 500).alias("group_id"), F.col("o_orderkey").alias("replica_id"), F.concat(F.lit("host-"), (F.col("o_orderkey") % 16).cast("string")).alias("endpoint"))
    leaders = fresh.groupBy("group_id").agg(F.min("replica_id").alias("leader_id"))
    cached = o.select((F.col("o_custkey") % 500).alias("group_id")).distinct()
    groups, gone = fleet.merge_topology(cached, fresh.join(leaders, "group_id"))
    return groups.unionByName(gone.select("group_id", F.lit("").alias("leader_endpoint"), F.lit(0).cast("long").alias("members")))


def least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("long").alias("nth")).agg(F.min("l_partkey").alias("p"))
    first = line.groupBy("request").agg(F.min("nth").alias("turn"))
    return fleet.least_loaded(line.join(first, "request").select("request", "nth", F.concat(F.lit("e"), F.col("nth").cast("string")).alias("endpoint"), (F.col("p") % 6).alias("rtt"), "turn"))


def disk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("disk_id"), F.when(F.col("l_returnflag") == "R", "free").otherwise("alloc").alias("kind"), F.col("l_orderkey").alias("at"), F.col("l_quantity").cast("long").alias("units"))
    return fleet.disk_counters(events, 4096, 5000)


def free_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = block_records(spark, sf_dir).where("is_busy").groupBy("zone_id", "unit_offset").agg(F.max("unit_count").alias("unit_count"))
    requests = block_records(spark, sf_dir).where("NOT is_busy").select("zone_id", "unit_offset").distinct()
    gone, freed, unknown = fleet.free_blocks(busy, requests, 77)
    by_zone = lambda d, name: d.groupBy("zone_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
    return by_zone(gone, "gone").unionByName(by_zone(freed.where("freed_ts = 77"), "freed")).unionByName(by_zone(unknown, "unknown"))


def commit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = block_records(spark, sf_dir).where("is_busy").groupBy("zone_id", "unit_offset").agg(F.max("stamp").alias("stamp")).withColumn("state", F.when(F.col("stamp") % 3 == 0, "TENTATIVE").otherwise("COMMITTED"))
    return fleet.commit_blocks(busy, busy.where("stamp % 2 = 0")).groupBy("state").agg(F.count("*").alias("n"))


def cluster_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of all groups; racks, nodes and groups are counted in the topology."""
    counted = [t.agg(F.count("*").alias(n)) for t, n in ((racks(spark, sf_dir), "racks"), (nodes(spark, sf_dir), "nodes"), (disk_groups(spark, sf_dir), "groups"))]
    used = dg_usage_rows(spark, sf_dir).agg(*(F.sum(c).alias(c) for c in ("capacity_bytes", "used_bytes", "free_bytes")))
    for one_row in counted:
        used = used.crossJoin(one_row)
    return used


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.workload(spark, 10_000, 500, 50, seed=9).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key_id").alias("keys"))


QUERIES = {f.__name__: f for f in (kv_write_log, kv_pages, sysdata_decode, operations_log, replica_views, replica_reconcile, topology_merge, least_loaded, disk_counters, free_blocks, commit_blocks, cluster_usage, workload)}

_R = "SELECT o_custkey % 20 AS store_id, o_custkey % 300 AS group_id, o_orderkey % 5 AS replica_id, o_orderkey % 9 AS node_id FROM orders"
_B = "SELECT l_suppkey AS zone_id, (l_partkey * 64 + l_linenumber)::BIGINT AS unit_offset, l_returnflag <> 'R' AS is_busy, l_orderkey AS stamp FROM lineitem"

SQL = {
    "workload": "SELECT op, count(*) AS n, count(DISTINCT key_id) AS keys FROM (SELECT (((id + 9) % 1000003) * 1103515245 + 12345) % 2147483647 % 500 AS key_id, CASE WHEN (((id + 9) % 1000003) * 1103515245 + 24690) % 2147483647 % 100 < 50 THEN 'get' ELSE 'put' END AS op FROM range(10000) t(id)) GROUP BY 1",
    "kv_write_log": f"SELECT key, slot, value FROM ({live()}) WHERE key <> 'p{'0' * 17}042' UNION ALL SELECT 'a new key', 20000001, 1.5",
    "kv_pages": f"SELECT key, ((row_number() OVER (ORDER BY key) - 1) // 1000)::INTEGER AS page FROM ({live('slot <= 14000')})",
    "sysdata_decode": "SELECT (props ->> 'k')::BIGINT AS k, count(*) AS n, min('/sys/' || event_id) AS first_key FROM events GROUP BY 1",
    "operations_log": "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1",
    "replica_views": f"SELECT store_id, group_id, string_agg(DISTINCT replica_id::VARCHAR, ',' ORDER BY replica_id::VARCHAR) AS replicas, count(DISTINCT node_id) AS nodes FROM ({_R}) GROUP BY 1, 2",
    "replica_reconcile": f"WITH w AS (SELECT DISTINCT store_id, group_id, replica_id FROM ({_R}) WHERE node_id < 6), h AS (SELECT DISTINCT store_id, group_id, replica_id FROM ({_R}) WHERE node_id > 3), b AS (SELECT store_id, CASE WHEN h.x IS NULL THEN 'start' WHEN w.x IS NULL THEN 'stop' ELSE 'keep' END AS action FROM (SELECT *, 1 AS x FROM w) w FULL JOIN (SELECT *, 1 AS x FROM h) h USING (store_id, group_id, replica_id)) SELECT store_id, action, count(*) AS n FROM b GROUP BY 1, 2",
    "topology_merge": "WITH f AS (SELECT o_custkey % 500 AS group_id, o_orderkey AS r FROM orders WHERE o_custkey % 4 > 0) SELECT group_id, 'host-' || min(r) % 16 AS leader_endpoint, count(*) AS members FROM f GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey % 500, '', 0 FROM orders WHERE o_custkey % 500 NOT IN (SELECT group_id FROM f)",
    "least_loaded": "WITH c AS (SELECT l_orderkey AS request, l_linenumber AS nth, min(l_partkey) % 6 AS rtt FROM lineitem GROUP BY 1, 2), t AS (SELECT request, min(nth) AS turn, min(rtt) FILTER (rtt > 0) AS best, arg_min(rtt, nth) AS own FROM c GROUP BY 1) SELECT request, 'e' || CASE WHEN best IS NULL OR own = 0 OR best = own THEN turn ELSE (SELECT min(nth) FROM c WHERE c.request = t.request AND c.rtt = t.best) END AS endpoint FROM t",
    "disk_counters": "WITH p AS (SELECT l_suppkey AS disk_id, CASE WHEN l_returnflag = 'R' THEN 'free' ELSE 'alloc' END AS kind, l_orderkey // 5000 * 5000 AS period, count(*) AS n, (sum(l_quantity) * 4096)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2, 3) SELECT *, sum(n) OVER w::BIGINT AS total_n, sum(bytes) OVER w::BIGINT AS total_bytes FROM p WINDOW w AS (PARTITION BY disk_id, kind ORDER BY period ROWS UNBOUNDED PRECEDING)",
    "free_blocks": f"WITH b AS (SELECT DISTINCT zone_id, unit_offset FROM ({_B}) WHERE is_busy), r AS (SELECT DISTINCT zone_id, unit_offset FROM ({_B}) WHERE NOT is_busy), g AS (SELECT * FROM b SEMI JOIN r USING (zone_id, unit_offset)) SELECT zone_id, count(*) AS n, 'gone' AS kind FROM g GROUP BY 1 UNION ALL SELECT zone_id, count(*), 'freed' FROM g GROUP BY 1 UNION ALL SELECT zone_id, count(*), 'unknown' FROM (SELECT * FROM r ANTI JOIN b USING (zone_id, unit_offset)) GROUP BY 1",
    "commit_blocks": f"SELECT CASE WHEN s % 3 = 0 AND s % 2 <> 0 THEN 'TENTATIVE' ELSE 'COMMITTED' END AS state, count(*) AS n FROM (SELECT max(stamp) AS s FROM ({_B}) WHERE is_busy GROUP BY zone_id, unit_offset) GROUP BY 1",
    "cluster_usage": "WITH u AS (SELECT l_suppkey, count(*) * 100 AS c, sum(l_quantity)::BIGINT AS s FROM lineitem GROUP BY 1) SELECT sum(c)::BIGINT AS capacity_bytes, sum(s)::BIGINT AS used_bytes, sum(greatest(0, c - s))::BIGINT AS free_bytes, (SELECT count(*) FROM region) AS racks, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM supplier) AS groups FROM u",
}
