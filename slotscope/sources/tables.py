"""The driver's tables, and their projections into the library's model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(prefix: str, number: str) -> Column:
    """An ordered text key: the prefix and the number in twenty digits."""
    return F.concat(F.lit(prefix), F.lpad(F.col(number).cast("string"), 20, "0"))


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation a line: slot, place in the batch, key, delete or put, value."""
    return table(spark, sf_dir, "lineitem").select(
        text_key("p", "l_partkey").alias("key"), F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("seq"),
        (F.col("l_returnflag") == "R").alias("is_delete"), F.col("l_quantity").alias("value"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(text_key("u", "user_id").alias("key"), F.col("event_id").alias("slot"), F.lit(0).alias("seq"), (F.col("event_type") == "error").alias("is_delete"), "value", "ts")


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.greatest(F.lit(1), F.floor(F.col("value") * 1000)).cast("long").alias("micros"), "ts", "event_id", "user_id")


def racks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("rack_id"), F.when(F.col("r_regionkey") == 4, 2).otherwise(1).alias("rack_status"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("rack_id"), F.when(n % 7 == 3, 3).otherwise(1).alias("node_status"))


def disk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("dg_id"), F.col("s_nationkey").cast("long").alias("node_id"), F.when(s % 11 == 5, 5).otherwise(1).alias("dg_status"))


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk for each pair of supplier and order priority of use: dg, status, capacity and busy units."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("dg_id"), F.col("l_linenumber").cast("long").alias("disk_no")).agg(
        (F.count("*") * 64).alias("capacity_bytes"), F.sum(F.when(F.col("l_returnflag") == "N", 64).otherwise(F.col("l_linenumber"))).cast("long").alias("busy_bytes"),
    ).withColumn("disk_status", F.when((F.col("dg_id") + F.col("disk_no")) % 13 == 0, 5).otherwise(1))


def dg_usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("dg_id")).agg(
        (F.count("*") * 100).alias("capacity_bytes"), F.sum(F.col("l_quantity")).cast("long").alias("used_bytes"),
    ).withColumn("free_bytes", F.greatest(F.lit(0), F.col("capacity_bytes") - F.col("used_bytes")))


def block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy and free records of zones: offset, units, and when a block was freed."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("zone_id"), (F.col("l_partkey") * 64 + F.col("l_linenumber")).cast("long").alias("unit_offset"),
        (F.col("l_quantity") % 4 + 1).cast("long").alias("unit_count"), (F.col("l_returnflag") != "R").alias("is_busy"), F.col("l_orderkey").alias("stamp"), F.col("l_partkey").alias("owner"),
    )
