"""Replicas, topology, counters of disks, and the choice of an endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replica_views(reports: DataFrame) -> DataFrame:
    """Per (store, group): the replicas that nodes report, in order, and how many nodes report it."""
    return reports.groupBy("store_id", "group_id").agg(F.array_join(F.array_sort(F.collect_set("replica_id")).cast("array<string>"), ",").alias("replicas"), F.count_distinct("node_id").alias("nodes"))


def reconcile_replicas(recorded: DataFrame, running: DataFrame) -> DataFrame:
    """Replicas to start, to stop or to keep, per (store, group)."""
    keys = ["store_id", "group_id", "replica_id"]
    both = recorded.select(*keys, F.lit(True).alias("want")).join(running.select(*keys, F.lit(True).alias("have")), keys, "full")
    return both.select(*keys, F.when(F.col("have").isNull(), "start").when(F.col("want").isNull(), "stop").otherwise("keep").alias("action"))


def merge_topology(cached: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fresh groups with their leader's endpoint, and the cached groups that are gone.

    fresh has a row for each member (group_id, replica_id, endpoint, leader_id); cached has group_id.
    """
    leader = F.max(F.when(F.col("replica_id") == F.col("leader_id"), F.col("endpoint")))
    groups = fresh.groupBy("group_id").agg(leader.alias("leader_endpoint"), F.count("*").alias("members"))
    return groups, cached.join(fresh.select("group_id").distinct(), "group_id", "left_anti")


def least_loaded(candidates: DataFrame) -> DataFrame:
    """Per request the endpoint of the least round trip; ties, and endpoints without history, leave the turn's own choice.

    candidates has (request, nth, endpoint, rtt), rtt 0 without history, and turn, the index whose turn it is.
    """
    known = F.min(F.when(F.col("rtt") > 0, F.struct("rtt", (F.col("nth") != F.col("turn")).alias("other"), "nth", "endpoint")))
    own = F.max(F.when(F.col("nth") == F.col("turn"), F.struct("rtt", "endpoint")))
    picked = F.when(F.col("best").isNull() | (F.col("own.rtt") == 0) | (F.col("best.rtt") == F.col("own.rtt")), F.col("own.endpoint")).otherwise(F.col("best.endpoint"))
    return candidates.groupBy("request").agg(known.alias("best"), own.alias("own")).select("request", picked.alias("endpoint"))


def disk_counters(events: DataFrame, unit_bytes: int, seconds: int) -> DataFrame:
    """Per disk, kind (alloc or free) and period: events and bytes, and both running totals."""
    per = events.groupBy("disk_id", "kind", (F.floor(F.col("at") / seconds) * seconds).cast("long").alias("period")).agg(F.count("*").alias("n"), (F.sum("units") * unit_bytes).alias("bytes"))
    upto = W.partitionBy("disk_id", "kind").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("total_n", F.sum("n").over(upto)).withColumn("total_bytes", F.sum("bytes").over(upto))


def free_blocks(busy: DataFrame, requests: DataFrame, freed_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What freeing does in one batch: busy records that go, free records that come, and requests that nothing answers."""
    keys = ["zone_id", "unit_offset"]
    gone = busy.join(requests.select(*keys).distinct(), keys, "left_semi")
    return gone, gone.select(*keys, "unit_count", F.lit(freed_ns).cast("long").alias("freed_ts")), requests.join(busy.select(*keys), keys, "left_anti")


def commit_blocks(busy: DataFrame, committed: DataFrame) -> DataFrame:
    """Busy records with the named tentative ones committed."""
    marked = busy.join(committed.select("zone_id", "unit_offset", F.lit(True).alias("named")).distinct(), ["zone_id", "unit_offset"], "left")
    return marked.withColumn("state", F.when((F.col("state") == "TENTATIVE") & F.col("named"), "COMMITTED").otherwise(F.col("state"))).drop("named")


def workload(spark, n: int, key_space: int, read_percent: int, seed: int) -> DataFrame:
    """n operations with keys drawn from the key space, reads and writes mixed by percent; draws are a linear congruence of the number and the seed."""
    drawn = lambda salt: F.pmod(F.pmod(F.col("id") + seed, F.lit(1_000_003)) * 1_103_515_245 + salt * 12_345, F.lit(2_147_483_647))
    return spark.range(n).select("id", (drawn(1) % key_space).alias("key_id"), F.when(drawn(2) % 100 < read_percent, "get").otherwise("put").alias("op"))
