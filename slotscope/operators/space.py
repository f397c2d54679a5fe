"""Capacity and usage of the hardware tree, health and status, and the bindings of ranges to instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hardware states in order of severity.
INIT, UP, MAINTENANCE, SUSPECT, MISSING, BAD, OFFLINE = range(7)
#: The state changes that are allowed.
TRANSITIONS = ((INIT, UP), (INIT, OFFLINE), (INIT, MAINTENANCE), (UP, SUSPECT), (UP, OFFLINE), (UP, MAINTENANCE), (SUSPECT, UP), (SUSPECT, MISSING), (SUSPECT, OFFLINE), (MISSING, BAD), (MISSING, UP), (OFFLINE, MAINTENANCE), (OFFLINE, UP), (MAINTENANCE, OFFLINE), (BAD, UP))


def dg_usage(disks: DataFrame) -> DataFrame:
    """Per disk group: capacity and busy bytes of all disks, bad ones too; free as their difference, 0 at least; disks that are up."""
    total, busy = F.sum("capacity_bytes"), F.sum("busy_bytes")
    return disks.groupBy("dg_id").agg(total.alias("capacity_bytes"), busy.alias("busy_bytes"), F.greatest(F.lit(0), total - busy).alias("free_bytes"), F.count_if(F.col("disk_status") == UP).alias("allocatable_disks"))


def usage_ratio(used: Column, capacity: Column) -> Column:
    return F.when(capacity == 0, 0.0).otherwise(used / capacity)


def capacity_rollup(racks: DataFrame, nodes: DataFrame, groups: DataFrame, usage: DataFrame) -> DataFrame:
    """A row for each rack, node and group, and the whole: children and bytes; what has no children stays, with 0."""
    tree = racks.join(nodes, "rack_id", "left").join(groups, "node_id", "left").join(usage, "dg_id", "left")
    sums = [F.count_distinct("node_id").alias("nodes"), F.count_distinct("dg_id").alias("groups"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("capacity_bytes", "used_bytes", "free_bytes"))]
    level = lambda name, *keys: tree.groupBy(*keys).agg(*sums).select(F.lit(name).alias("level"), *(F.col(k) if k in keys else F.lit(None).cast("long").alias(k) for k in ("rack_id", "node_id", "dg_id")), "nodes", "groups", "capacity_bytes", "used_bytes", "free_bytes")
    return level("datacenter").unionByName(level("rack", "rack_id")).unionByName(level("node", "rack_id", "node_id").where("node_id IS NOT NULL")).unionByName(level("group", "rack_id", "node_id", "dg_id").where("dg_id IS NOT NULL"))


def usage_within(groups: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Usage by rack or node; groups are counted where they report usage."""
    return usage.join(groups, "dg_id").groupBy(key).agg(F.count("*").alias("groups"), *(F.sum(c).alias(c) for c in ("capacity_bytes", "used_bytes", "free_bytes")))


def merge_usage(answers: DataFrame) -> DataFrame:
    """Instances' answers for the same group added up, their disk lists joined; an instance that failed adds nothing."""
    return answers.where("ok").groupBy("dg_id").agg(*(F.sum(c).alias(c) for c in ("capacity_bytes", "busy_bytes")), F.sort_array(F.flatten(F.collect_list("disk_list"))).alias("disk_list"))


def live_instances(instances: DataFrame, now_ms: int, ttl_ms: int = 15_000) -> DataFrame:
    return instances.where(F.col("last_heartbeat_ms") >= max(0, now_ms - ttl_ms))


def healthy_groups(racks: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that are up on nodes that are up in racks that are up."""
    return groups.where(F.col("dg_status") == UP).join(nodes.where(F.col("node_status") == UP), "node_id").join(racks.where(F.col("rack_status") == UP), "rack_id")


def excluding(groups: DataFrame, excluded: DataFrame) -> DataFrame:
    """Groups of none of the hints (kind: rack, node or dg; id)."""
    for kind, key in (("rack", "rack_id"), ("node", "node_id"), ("dg", "dg_id")):
        groups = groups.join(excluded.where(F.col("kind") == kind).select(F.col("id").alias(key)), key, "left_anti")
    return groups


def effective_status(*statuses: Column) -> Column:
    return F.greatest(*statuses)


def permitted(operation: str, status: Column) -> Column:
    """Whether a state allows an operation."""
    if operation == "allocate":
        return status == UP
    return status.isin(UP, MAINTENANCE, SUSPECT) if operation == "free" else F.lit(True)


def illegal_changes(changes: DataFrame, spark) -> DataFrame:
    """Changes (old, new) of state that aren't allowed; staying is."""
    legal = spark.createDataFrame(TRANSITIONS, "old int, new int")  # a fixed table
    return changes.where("old <> new").join(F.broadcast(legal), ["old", "new"], "left_anti")


def timed_out(suspects: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    return suspects.where(F.lit(now_ms) - F.col("since_ms") >= timeout_ms)


def group_health(replicas: DataFrame) -> DataFrame:
    """Per (store, group): replicas, alive ones, whether one leads, and the verdict."""
    n, alive, led = F.count("replica_id"), F.count_if("alive"), F.max(F.col("alive") & F.col("is_leader"))
    verdict = F.when(F.col("n") == 0, "Unknown").when((F.col("alive") == F.col("n")) & F.col("led"), "Healthy").when(F.col("alive") < F.floor(F.col("n") / 2) + 1, "Unavailable").otherwise("Degraded")
    return replicas.groupBy("store_id", "group_id").agg(n.alias("n"), alive.alias("alive"), F.coalesce(led, F.lit(False)).alias("led")).withColumn("health", verdict)


def store_summary(replicas: DataFrame) -> DataFrame:
    """Per (store, group): replicas, and the leader that the lowest-numbered node knows of."""
    hint = F.min_by("leader_hint", F.when(F.col("leader_hint").isNotNull(), F.col("node_id")))
    return replicas.groupBy("store_id", "group_id").agg(F.count("*").alias("replica_count"), hint.alias("leader_hint"))


def assign_ranges(instances: DataFrame, n_ranges: int, buckets: int = 1 << 16) -> DataFrame:
    """Sub-range i of n goes to instance i * N div n of the N in order of id, rounded as the owner index asks; the last range ends at the last bucket."""
    spark = instances.sparkSession
    ranked = instances.select("instance_id", (F.row_number().over(W.orderBy("instance_id")) - 1).alias("nth"), F.count("*").over(W.partitionBy(F.lit(0))).alias("n"))
    sub = spark.range(n_ranges).withColumnRenamed("id", "sub_range")
    width = buckets // n_ranges
    owned = sub.join(ranked, F.floor(F.col("sub_range") * F.col("n") / n_ranges) == F.col("nth"))
    return owned.select("sub_range", (F.col("sub_range") * width).alias("start"), F.when(F.col("sub_range") == n_ranges - 1, buckets - 1).otherwise((F.col("sub_range") + 1) * width - 1).alias("end"), "instance_id")


def binding_changes(desired: DataFrame, current: DataFrame) -> DataFrame:
    """What to write: desired ranges whose owner differs; those in transition keep what they have. Without any instance nothing is desired, and all keep what they have."""
    now = current.select("sub_range", F.col("instance_id").alias("current_id"), "in_transition")
    action = F.when(F.col("current_id").isNull(), "create").when(F.col("in_transition") | F.col("instance_id").isNull(), "keep").when(F.col("current_id") == F.col("instance_id"), "keep").otherwise("move")
    return desired.join(now, "sub_range", "full").select("sub_range", F.coalesce("instance_id", "current_id").alias("instance_id"), action.alias("action"))


def route(buckets: DataFrame, ranges: DataFrame, n_ranges: int = 256) -> DataFrame:
    """Each bucket's owner by inclusive ranges [start, end].

    Ranges are spread over the cells of a grid that they touch, so that the join is by equal cells, not by all pairs.
    """
    cell = (1 << 16) // n_ranges
    spread = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    return buckets.withColumn("cell", F.floor(F.col("bucket") / cell)).join(spread, "cell").where((F.col("bucket") >= F.col("start")) & (F.col("bucket") <= F.col("end"))).drop("cell")


def outside_ranges(rows: DataFrame, owned: DataFrame, allow_all_if_empty: bool = False) -> DataFrame:
    """Rows whose bucket no owned range holds; without any range all are refused, or none if so configured."""
    if allow_all_if_empty and owned.limit(1).count() == 0:
        return rows.limit(0)
    return rows.join(route(rows.select("bucket").distinct(), owned).select("bucket"), "bucket", "left_anti")


def primary_or_fallback(wanted: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """A key's value in the new group, else in the old one while that is still read."""
    return wanted.join(new.select("key", F.col("value").alias("new_value")), "key", "left").join(old.select("key", F.col("value").alias("old_value")), "key", "left").select("key", F.coalesce("new_value", F.when(F.col("copying"), F.col("old_value"))).alias("value"), F.when(F.col("new_value").isNotNull(), "new").when(F.col("copying") & F.col("old_value").isNotNull(), "old").otherwise("none").alias("place"))


def reconcile_disks(desired: DataFrame, known: DataFrame, most_misses: int = 3) -> DataFrame:
    """Desired disks against known ones: add, check the state, or count a miss and drop at the limit."""
    both = desired.withColumnRenamed("status", "desired_status").join(known.withColumnRenamed("status", "known_status"), "disk_id", "full")
    misses = F.when(F.col("desired_status").isNull(), F.col("misses") + 1).otherwise(0)
    action = F.when(F.col("known_status").isNull(), "add").when(F.col("desired_status").isNull(), F.when(F.col("misses") + 1 >= most_misses, "remove").otherwise("miss")).when(F.col("desired_status") != F.col("known_status"), "update").otherwise("keep")
    return both.select("disk_id", action.alias("action"), misses.cast("long").alias("misses"))
