"""Chunks that orders make, with their lines as strips; cascades and trees of the hardware; configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import chunk
from slotscope.sources.tables import disk_groups, nodes, table


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip for each order and line number: lines of one number are one strip."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("strip_index"))
    return line.agg(F.sum("l_quantity").cast("long").alias("capacity"), F.array_sort(F.collect_list("l_partkey")).alias("segments"))


def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.segments(chunk.chunks_of(_strips(spark, sf_dir)))


def chunk_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.capacity(chunk.chunks_of(_strips(spark, sf_dir)))


def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.capacity(chunk.delete_range(chunk.chunks_of(_strips(spark, sf_dir)), 20, 50))


def update_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return chunk.segments(chunk.replace_strip(chunk.chunks_of(_strips(spark, sf_dir)), 2, new)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("segment").alias("total"))


def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    command = F.when(o % 11 == 0, "seal").when(o % 29 == 0, "delete").otherwise("append")
    return chunk.fold_commands(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("chunk_id"), o.alias("at"), command.alias("command"), (o % 100).alias("bytes")))


def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all bindings in order of key, then limited as a whole."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("/chunk/"), F.lpad(F.hex("o_orderkey"), 16, "0")).alias("key"), (F.col("o_orderkey") % 3).alias("binding"))
    return o.where("binding <> 1").orderBy("key").limit(200)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with racks 1 and 3."""
    gone_nodes = nodes(spark, sf_dir).where("rack_id IN (1, 3)")
    gone_groups = chunk.cascade(gone_nodes, disk_groups(spark, sf_dir), "node_id")
    return gone_nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(gone_groups.select(F.lit("group").alias("kind"), F.col("dg_id").alias("id")))


def tree_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Racks to nodes to groups, nested; the deepest level is cut to three and says so."""
    groups = disk_groups(spark, sf_dir).groupBy("node_id").agg(F.array_sort(F.collect_list("dg_id")).alias("g"))
    per_node = nodes(spark, sf_dir).join(groups, "node_id", "left").select("rack_id", "node_id", F.slice(F.coalesce("g", F.array().cast("array<bigint>")), 1, 3).alias("groups"), (F.coalesce(F.size("g"), F.lit(0)) > 3).alias("cut"))
    nested = per_node.groupBy("rack_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "groups", "cut"))).alias("nodes"))
    return nested.select("rack_id", F.size("nodes").cast("long").alias("n_nodes"), F.size(F.filter("nodes", lambda n: n["cut"])).cast("long").alias("n_cut"), F.array_join(F.transform(F.flatten(F.col("nodes.groups")), lambda x: x.cast("string")), ",").alias("shown"))


def recovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a failed disk by zone, from where the last scan stopped."""
    hit = table(spark, sf_dir, "lineitem").where("l_linenumber = 3 AND l_suppkey > 20 AND l_returnflag <> 'R'")
    return hit.groupBy(F.col("l_suppkey").alias("zone_id")).agg(F.count("*").alias("blocks"), F.count_distinct("l_orderkey").alias("chunks"))


def bucket_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of moving buckets are copied to the new group; after cleanup the old one is without them."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") * 31 % 1024).alias("bucket"), (F.col("o_custkey") % 2).alias("group"))
    moving = (F.col("bucket").between(100, 299)) & (F.col("group") == 0)
    return rows.withColumn("group", F.when(moving, 1).otherwise(F.col("group"))).groupBy("group").agg(F.count("*").alias("n"), F.sum("bucket").alias("buckets"))


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("string").alias("value"))
    new = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") - F.col("p_partkey") % 2).cast("string").alias("value"))
    return chunk.config_diff(old, new).select("path", "change", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


def config_diff_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of three levels, a config a part; some lose a whole branch and some values change."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = lambda n: F.struct(F.struct(n.alias("units"), F.struct(F.col("p_type").alias("kind")).alias("box")).alias("size"), F.col("p_brand").alias("brand"))
    old = p.select(k, F.to_json(size(F.col("p_size"))).alias("config"))
    new = p.select(k, F.to_json(F.when(k % 4 == 0, F.struct(F.lit(None).cast("struct<units:bigint,box:struct<kind:string>>").alias("size"), F.col("p_brand").alias("brand"))).otherwise(size(F.col("p_size") + k % 2))).alias("config"))
    found = chunk.config_diff(chunk.flatten_config(old, "p_partkey", "config"), chunk.flatten_config(new, "p_partkey", "config"), "p_partkey")
    return found.select("p_partkey", "path", "change", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


QUERIES = {f.__name__: f for f in (chunk_segments, chunk_capacity, delete_range, update_strip, chunk_states, chunk_list, cascade_delete, tree_expand, recovery_scan, bucket_migration, config_diff, config_diff_nested)}

_S = "SELECT l_orderkey AS chunk_id, l_linenumber::BIGINT AS strip_index, sum(l_quantity)::BIGINT AS capacity FROM lineitem GROUP BY 1, 2"
_AT = f"SELECT *, coalesce(sum(capacity) OVER (PARTITION BY chunk_id ORDER BY strip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_offset FROM ({_S})"

SQL = {
    "chunk_segments": "SELECT l_orderkey AS chunk_id, l_linenumber::BIGINT AS strip_index, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) - 1 AS segment_index, l_partkey AS segment FROM lineitem",
    "chunk_capacity": f"SELECT chunk_id, sum(capacity)::BIGINT AS capacity, count(*) AS n_strips FROM ({_S}) GROUP BY 1",
    "delete_range": f"SELECT chunk_id, coalesce(sum(capacity) FILTER (keep), 0)::BIGINT AS capacity, count(*) FILTER (keep) AS n_strips FROM (SELECT *, NOT (chunk_offset < 70 AND chunk_offset + capacity > 20) AS keep FROM ({_AT})) GROUP BY 1",
    "update_strip": "SELECT chunk_id, sum(n)::BIGINT AS n, sum(t)::BIGINT AS total FROM (SELECT l_orderkey AS chunk_id, l_linenumber, CASE WHEN l_linenumber = 2 THEN 2 ELSE count(*) END AS n, CASE WHEN l_linenumber = 2 THEN 1 ELSE sum(l_partkey) END AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "chunk_states": """WITH c AS (SELECT o_custkey % 400 AS chunk_id, o_orderkey AS t, CASE WHEN o_orderkey % 11 = 0 THEN 'seal' WHEN o_orderkey % 29 = 0 THEN 'delete' ELSE 'append' END AS command, o_orderkey % 100 AS bytes FROM orders),
m AS (SELECT *, min(t) FILTER (command = 'seal') OVER w AS sealed, min(t) FILTER (command = 'delete') OVER w AS deleted FROM c WINDOW w AS (PARTITION BY chunk_id)),
k AS (SELECT *, CASE WHEN command = 'delete' THEN t <= deleted ELSE t <= coalesce(sealed, t) AND t < coalesce(deleted, t + 1) END AS allowed FROM m)
SELECT chunk_id, CASE WHEN any_value(deleted) IS NOT NULL THEN 'DELETED' WHEN any_value(sealed) IS NOT NULL THEN 'SEALED' ELSE 'ACTIVE' END AS state, count(*) FILTER (NOT allowed) AS refused, coalesce(sum(bytes) FILTER (allowed AND command = 'append'), 0)::BIGINT AS bytes FROM k GROUP BY 1""",
    "chunk_list": "SELECT '/chunk/' || lpad(upper(to_hex(o_orderkey)), 16, '0') AS key, o_orderkey % 3 AS binding FROM orders WHERE o_orderkey % 3 <> 1 ORDER BY key LIMIT 200",
    "cascade_delete": "SELECT 'node' AS kind, n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'group', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))",
    "tree_expand": "WITH g AS (SELECT n_regionkey::BIGINT AS rack_id, n_nationkey AS node_id, s_suppkey AS dg_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS nth FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey) SELECT rack_id, count(DISTINCT node_id) AS n_nodes, count(DISTINCT node_id) FILTER (nth > 3) AS n_cut, coalesce(string_agg(dg_id::VARCHAR, ',' ORDER BY node_id, dg_id) FILTER (nth <= 3), '') AS shown FROM g GROUP BY 1",
    "recovery_scan": "SELECT l_suppkey AS zone_id, count(*) AS blocks, count(DISTINCT l_orderkey) AS chunks FROM lineitem WHERE l_linenumber = 3 AND l_suppkey > 20 AND l_returnflag <> 'R' GROUP BY 1",
    "bucket_migration": "SELECT CASE WHEN b BETWEEN 100 AND 299 AND g = 0 THEN 1 ELSE g END AS \"group\", count(*) AS n, sum(b)::BIGINT AS buckets FROM (SELECT o_orderkey * 31 % 1024 AS b, o_custkey % 2 AS g FROM orders) GROUP BY 1",
    "config_diff_nested": "SELECT p_partkey, 'size.units' AS path, CASE WHEN p_partkey % 4 = 0 THEN 'removed' ELSE 'changed' END AS change, p_size::VARCHAR AS old, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE (p_size + 1)::VARCHAR END AS new FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'size.box.kind', 'removed', p_type, '' FROM part WHERE p_partkey % 4 = 0",
    "config_diff": "WITH o AS (SELECT p_brand || '.' || p_partkey AS path, p_size::VARCHAR AS value FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_brand || '.' || p_partkey AS path, (p_size - p_partkey % 2)::VARCHAR AS value FROM part WHERE p_partkey % 4 <> 0) SELECT path, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(o.value, '') AS old, coalesce(n.value, '') AS new FROM o FULL JOIN n USING (path) WHERE o.value IS DISTINCT FROM n.value",
}
