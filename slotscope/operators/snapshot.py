"""Pinned snapshots: resolved cells as Parquet, one folder a handle, with a manifest of slots and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators.kv import prefix_bounds, resolve

LEASE_MS = 5 * 60 * 1000
MANIFEST = "handle string, at_slot long, created_ms long, lease_ms long"


def create(log: DataFrame, root: str, handle: str, at_slot: int, now_ms: int, lease_ms: int = LEASE_MS) -> None:
    """Writes the cells as of at_slot, tombstones included, sorted by key; then the manifest's row, which makes them visible."""
    spark = log.sparkSession
    resolve(log, at_slot).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{root}/cells/{handle}")
    spark.createDataFrame([(handle, at_slot, now_ms, lease_ms)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str, now_ms: int) -> DataFrame:
    """Snapshots whose lease holds."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(F.col("created_ms") + F.col("lease_ms") > now_ms)


def cells(spark: SparkSession, root: str, handle: str) -> DataFrame:
    return spark.read.parquet(f"{root}/cells/{handle}")


def scan(spark: SparkSession, root: str, handle: str, prefix: str = "", limit: int = 0) -> DataFrame:
    """Live rows of a snapshot in key order."""
    rows = cells(spark, root, handle).where(prefix_bounds(F.col("key"), prefix) & ~F.col("is_delete")).select("key", "slot", "value").orderBy("key")
    return rows.limit(limit) if limit else rows


def release(spark: SparkSession, root: str, handle: str) -> None:
    """Deletes the cells; a manifest row of a handle without cells is passed over when its lease ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/cells/{handle}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_tail(spark: SparkSession, root: str, handle: str, at_slot: int, log: DataFrame) -> DataFrame:
    """A compacted read: a snapshot and the log after it, resolved together."""
    columns = ["key", "slot", "seq", "is_delete", "value"]
    return resolve(cells(spark, root, handle).select(columns).unionByName(log.where(F.col("slot") > at_slot).select(columns)))
