"""Capacity, health and bindings over the hardware tree that suppliers, nations and regions make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import space
from slotscope.sources.tables import dg_usage_rows, disk_groups, disks, nodes, racks, table


def capacity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = space.capacity_rollup(racks(spark, sf_dir), nodes(spark, sf_dir), disk_groups(spark, sf_dir), dg_usage_rows(spark, sf_dir))
    return found.select("level", *(F.coalesce(k, F.lit(-1)).alias(k) for k in ("rack_id", "node_id", "dg_id")), "nodes", "groups", "capacity_bytes", "used_bytes", "free_bytes")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disk_groups(spark, sf_dir).join(nodes(spark, sf_dir), "node_id")


def rack_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.usage_within(_placed(spark, sf_dir), dg_usage_rows(spark, sf_dir), "rack_id")


def node_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.usage_within(_placed(spark, sf_dir), dg_usage_rows(spark, sf_dir), "node_id")


def dg_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.dg_usage(disks(spark, sf_dir)).withColumn("ratio", space.usage_ratio(F.col("busy_bytes"), F.col("capacity_bytes")))


def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disks(spark, sf_dir)
    answers = d.groupBy("dg_id", (F.col("disk_no") % 2).alias("instance")).agg(F.sum("capacity_bytes").alias("capacity_bytes"), F.sum("busy_bytes").alias("busy_bytes"), F.collect_list("disk_no").alias("disk_list")).withColumn("ok", (F.col("dg_id") + F.col("instance")) % 10 != 0)
    merged = space.merge_usage(answers)
    return merged.select("dg_id", "capacity_bytes", "busy_bytes", F.concat_ws(",", F.transform("disk_list", lambda x: x.cast("string"))).alias("disk_list"))


def disk_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group's disks with what each has free."""
    return disks(spark, sf_dir).where("dg_id = 7").select("disk_no", "capacity_bytes", "busy_bytes", F.greatest(F.lit(0), F.col("capacity_bytes") - F.col("busy_bytes")).alias("free_bytes"))


def live_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return space.live_instances(beats.select(F.col("user_id").alias("instance_id"), (F.col("last") * 50).alias("last_heartbeat_ms")), now_ms=500_000)


def healthy_dgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.healthy_groups(racks(spark, sf_dir), nodes(spark, sf_dir), disk_groups(spark, sf_dir)).select("dg_id", "node_id", "rack_id")


def excluded_dgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = spark.createDataFrame([("rack", 1), ("node", 3), ("node", 8), ("dg", 12), ("dg", 20)], "kind string, id long")
    return space.excluding(_placed(spark, sf_dir), hints).select("dg_id", "node_id", "rack_id")


def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disks(spark, sf_dir).join(_placed(spark, sf_dir), "dg_id")
    status = space.effective_status(F.col("node_status"), F.col("dg_status"), F.col("disk_status"))
    return d.select("dg_id", "disk_no", status.alias("status"), space.permitted("allocate", status).alias("may_allocate"), space.permitted("free", status).alias("may_free"))


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("at"), (F.col("l_orderkey") % 7).cast("int").alias("old"), (F.col("l_partkey") % 7).cast("int").alias("new"))
    return space.illegal_changes(changes, spark).groupBy("old", "new").agg(F.count("*").alias("n"))


def suspect_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.timed_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("disk_id"), (F.col("o_orderkey") * 10).alias("since_ms")), 20_000, 15_000)


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select((c % 20).alias("store_id"), (c % 300).alias("group_id"), o.alias("replica_id"), o.alias("node_id"), (o % 3 < 2).alias("alive"), (o % 5 == 0).alias("is_leader"), F.when(o % 6 == 1, c).alias("leader_hint"))


def group_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.group_health(_replicas(spark, sf_dir))


def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.store_summary(_replicas(spark, sf_dir)).withColumn("leader_hint", F.coalesce("leader_hint", F.lit(-1)))


def _instances(spark: SparkSession, sf_dir: str, without_region: int) -> DataFrame:
    """An instance a nation, but for those of a region that is down."""
    return table(spark, sf_dir, "nation").where(F.col("n_regionkey") != without_region).select(F.col("n_nationkey").cast("long").alias("instance_id"))


def range_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.assign_ranges(_instances(spark, sf_dir, 1), 64)


def incremental_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = space.assign_ranges(_instances(spark, sf_dir, 1), 64).where("sub_range % 10 <> 7").withColumn("in_transition", F.col("sub_range") % 8 == 3)
    return space.binding_changes(space.assign_ranges(_instances(spark, sf_dir, 3), 64), before)


def binding_without_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All instances are gone: what is bound stays so."""
    before = space.assign_ranges(_instances(spark, sf_dir, 1), 64).withColumn("in_transition", F.lit(False))
    return space.binding_changes(space.assign_ranges(_instances(spark, sf_dir, 1).where("instance_id < 0"), 64), before)


def bucket_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = space.assign_ranges(_instances(spark, sf_dir, 1), 64)
    buckets = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 65536).alias("bucket"))
    return space.route(buckets, ranges).groupBy("instance_id").agg(F.count("*").alias("n"), F.min("bucket").alias("least"), F.max("bucket").alias("most"))


def range_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = spark.createDataFrame([(0, 999), (5000, 5999), (60000, 65535)], "start long, end long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 65536).alias("bucket"))
    return space.outside_ranges(rows, owned).agg(F.count("*").alias("refused"), F.sum("bucket").alias("buckets"))


def primary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"), "o_orderstatus")
    wanted = o.select("key", (F.col("o_orderstatus") != "F").alias("copying"))
    return space.primary_or_fallback(wanted, o.where("key % 3 = 0"), o.where("key % 2 = 0")).select("key", F.coalesce("value", F.lit(-1)).alias("value"), "place")


def disk_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    desired = p.where("p_partkey % 5 <> 0").select(k.alias("disk_id"), (k % 3).alias("status"))
    known = p.where("p_partkey % 7 <> 0").select(k.alias("disk_id"), (k % 4 % 3).alias("status"), (k % 3).cast("int").alias("misses"))
    return space.reconcile_disks(desired, known)


QUERIES = {f.__name__: f for f in (capacity_rollup, rack_usage, node_usage, dg_usage, usage_merge, disk_drilldown, live_instances, healthy_dgs, excluded_dgs, effective_status, illegal_transitions, suspect_timeout, group_health, store_summary, range_assignment, incremental_binding, binding_without_instances, bucket_route, range_guard, primary_fallback, disk_reconcile)}

_WITH = """WITH racks AS (SELECT r_regionkey::BIGINT AS rack_id, CASE WHEN r_regionkey = 4 THEN 2 ELSE 1 END AS rack_status FROM region),
nodes AS (SELECT n_nationkey::BIGINT AS node_id, n_regionkey::BIGINT AS rack_id, CASE WHEN n_nationkey % 7 = 3 THEN 3 ELSE 1 END AS node_status FROM nation),
dgs AS (SELECT s_suppkey AS dg_id, s_nationkey::BIGINT AS node_id, CASE WHEN s_suppkey % 11 = 5 THEN 5 ELSE 1 END AS dg_status FROM supplier),
disks AS (SELECT *, CASE WHEN (dg_id + disk_no) % 13 = 0 THEN 5 ELSE 1 END AS disk_status FROM (SELECT l_suppkey AS dg_id, l_linenumber::BIGINT AS disk_no, count(*) * 64 AS capacity_bytes, sum(CASE WHEN l_returnflag = 'N' THEN 64 ELSE l_linenumber END)::BIGINT AS busy_bytes FROM lineitem GROUP BY 1, 2)),
usage AS (SELECT *, greatest(0, capacity_bytes - used_bytes) AS free_bytes FROM (SELECT l_suppkey AS dg_id, count(*) * 100 AS capacity_bytes, sum(l_quantity)::BIGINT AS used_bytes FROM lineitem GROUP BY 1)),
replicas AS (SELECT o_custkey % 20 AS store_id, o_custkey % 300 AS group_id, o_orderkey AS replica_id, o_orderkey AS node_id, o_orderkey % 3 < 2 AS alive, o_orderkey % 5 = 0 AS is_leader, CASE WHEN o_orderkey % 6 = 1 THEN o_custkey END AS leader_hint FROM orders)
"""


def _ranges(m: int, name: str) -> str:
    return f"{name} AS (SELECT i AS sub_range, i * 1024 AS start, CASE WHEN i = 63 THEN 65535 ELSE i * 1024 + 1023 END AS \"end\", instance_id FROM (SELECT unnest(range(64)) AS i) JOIN (SELECT n_nationkey::BIGINT AS instance_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS nth, count(*) OVER () AS n FROM nation WHERE n_regionkey <> {m}) ON i * n // 64 = nth)"


_SUMS = "count(DISTINCT node_id) AS nodes, count(DISTINCT dg_id) AS groups, coalesce(sum(capacity_bytes), 0)::BIGINT AS capacity_bytes, coalesce(sum(used_bytes), 0)::BIGINT AS used_bytes, coalesce(sum(free_bytes), 0)::BIGINT AS free_bytes"
_TREE = "FROM racks LEFT JOIN nodes USING (rack_id) LEFT JOIN dgs USING (node_id) LEFT JOIN usage USING (dg_id)"
_USED = "count(*) AS groups, sum(capacity_bytes)::BIGINT AS capacity_bytes, sum(used_bytes)::BIGINT AS used_bytes, sum(free_bytes)::BIGINT AS free_bytes FROM usage JOIN dgs USING (dg_id) JOIN nodes USING (node_id) GROUP BY 1"

SQL = {
    "capacity_rollup": _WITH + f"""SELECT 'datacenter' AS level, -1 AS rack_id, -1 AS node_id, -1 AS dg_id, {_SUMS} {_TREE}
UNION ALL SELECT 'rack', rack_id, -1, -1, {_SUMS} {_TREE} GROUP BY rack_id
UNION ALL SELECT 'node', rack_id, node_id, -1, {_SUMS} {_TREE} WHERE node_id IS NOT NULL GROUP BY rack_id, node_id
UNION ALL SELECT 'group', rack_id, node_id, dg_id, {_SUMS} {_TREE} WHERE dg_id IS NOT NULL GROUP BY rack_id, node_id, dg_id""",
    "rack_usage": _WITH + f"SELECT rack_id, {_USED}",
    "node_usage": _WITH + f"SELECT node_id, {_USED}",
    "dg_usage": _WITH + "SELECT *, CASE WHEN capacity_bytes = 0 THEN 0.0 ELSE busy_bytes / capacity_bytes END AS ratio FROM (SELECT dg_id, sum(capacity_bytes)::BIGINT AS capacity_bytes, sum(busy_bytes)::BIGINT AS busy_bytes, greatest(0, sum(capacity_bytes) - sum(busy_bytes))::BIGINT AS free_bytes, count(*) FILTER (disk_status = 1) AS allocatable_disks FROM disks GROUP BY 1)",
    "usage_merge": _WITH + "SELECT dg_id, sum(capacity_bytes)::BIGINT AS capacity_bytes, sum(busy_bytes)::BIGINT AS busy_bytes, string_agg(disk_no::VARCHAR, ',' ORDER BY disk_no) AS disk_list FROM disks WHERE (dg_id + disk_no % 2) % 10 <> 0 GROUP BY 1",
    "disk_drilldown": _WITH + "SELECT disk_no, capacity_bytes, busy_bytes, greatest(0, capacity_bytes - busy_bytes) AS free_bytes FROM disks WHERE dg_id = 7",
    "live_instances": "SELECT * FROM (SELECT user_id AS instance_id, max(event_id) * 50 AS last_heartbeat_ms FROM events GROUP BY 1) WHERE last_heartbeat_ms >= 485000",
    "healthy_dgs": _WITH + "SELECT dg_id, node_id, rack_id FROM dgs JOIN nodes USING (node_id) JOIN racks USING (rack_id) WHERE dg_status = 1 AND node_status = 1 AND rack_status = 1",
    "excluded_dgs": _WITH + "SELECT dg_id, node_id, rack_id FROM dgs JOIN nodes USING (node_id) WHERE rack_id NOT IN (1) AND node_id NOT IN (3, 8) AND dg_id NOT IN (12, 20)",
    "effective_status": _WITH + "SELECT dg_id, disk_no, s AS status, s = 1 AS may_allocate, s IN (1, 2, 3) AS may_free FROM (SELECT dg_id, disk_no, greatest(node_status, dg_status, disk_status) AS s FROM disks JOIN dgs USING (dg_id) JOIN nodes USING (node_id))",
    "illegal_transitions": f"SELECT old, new, count(*) AS n FROM (SELECT (l_orderkey % 7)::INTEGER AS old, (l_partkey % 7)::INTEGER AS new FROM lineitem) WHERE old <> new AND (old, new) NOT IN ({', '.join(f'({a}, {b})' for a, b in space.TRANSITIONS)}) GROUP BY 1, 2",
    "suspect_timeout": "SELECT o_orderkey AS disk_id, o_orderkey * 10 AS since_ms FROM orders WHERE 20000 - o_orderkey * 10 >= 15000",
    "group_health": _WITH + "SELECT *, CASE WHEN n = 0 THEN 'Unknown' WHEN alive = n AND led THEN 'Healthy' WHEN alive < n // 2 + 1 THEN 'Unavailable' ELSE 'Degraded' END AS health FROM (SELECT store_id, group_id, count(*) AS n, count(*) FILTER (alive) AS alive, bool_or(alive AND is_leader) AS led FROM replicas GROUP BY 1, 2)",
    "store_summary": _WITH + "SELECT store_id, group_id, count(*) AS replica_count, coalesce(arg_min(leader_hint, node_id) FILTER (leader_hint IS NOT NULL), -1) AS leader_hint FROM replicas GROUP BY 1, 2",
    "range_assignment": f"WITH {_ranges(1, 'a')} SELECT * FROM a",
    "incremental_binding": f"WITH {_ranges(1, 'b')}, {_ranges(3, 'a')} SELECT a.sub_range, a.instance_id, CASE WHEN c.instance_id IS NULL THEN 'create' WHEN c.sub_range % 8 = 3 THEN 'keep' WHEN c.instance_id = a.instance_id THEN 'keep' ELSE 'move' END AS action FROM a LEFT JOIN (SELECT * FROM b WHERE sub_range % 10 <> 7) c USING (sub_range)",
    "binding_without_instances": f"WITH {_ranges(1, 'a')} SELECT sub_range, instance_id, 'keep' AS action FROM a",
    "bucket_route": f"WITH {_ranges(1, 'a')} SELECT instance_id, count(*) AS n, min(bucket) AS least, max(bucket) AS most FROM (SELECT o_orderkey * 7919 % 65536 AS bucket FROM orders) JOIN a ON bucket BETWEEN start AND \"end\" GROUP BY 1",
    "range_guard": "SELECT count(*) AS refused, sum(b)::BIGINT AS buckets FROM (SELECT o_orderkey * 7919 % 65536 AS b FROM orders) WHERE NOT (b BETWEEN 0 AND 999 OR b BETWEEN 5000 AND 5999 OR b >= 60000)",
    "primary_fallback": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderstatus <> 'F') THEN o_custkey ELSE -1 END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'old' ELSE 'none' END AS place FROM orders",
    "disk_reconcile": "WITH d AS (SELECT p_partkey AS disk_id, p_partkey % 3 AS ds FROM part WHERE p_partkey % 5 <> 0), k AS (SELECT p_partkey AS disk_id, p_partkey % 4 % 3 AS ks, p_partkey % 3 AS misses FROM part WHERE p_partkey % 7 <> 0) SELECT disk_id, CASE WHEN ks IS NULL THEN 'add' WHEN ds IS NULL THEN CASE WHEN misses + 1 >= 3 THEN 'remove' ELSE 'miss' END WHEN ds <> ks THEN 'update' ELSE 'keep' END AS action, CASE WHEN ds IS NULL THEN misses + 1 ELSE 0 END AS misses FROM d FULL JOIN k USING (disk_id)",
}
