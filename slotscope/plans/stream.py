"""Streams over the driver's tables, run to what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.plans.kv import LOG
from slotscope.sources.folders import shared_folder
from slotscope.sources.tables import table, text_key
from slotscope.streaming import watch

PREFIXES = ("p" + "0" * 18, "p" + "0" * 17 + "1", "p" + "0" * 16 + "17")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def watch_notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _stream(spark, sf_dir, "lineitem").select(text_key("p", "l_partkey").alias("key"), F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("seq"), (F.col("l_returnflag") == "R").alias("is_delete"), F.col("l_quantity").cast("long").alias("value"))
    folder = shared_folder(spark, "stream")
    return watch.watch(log, spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"), f"{folder}/out", f"{folder}/checkpoint").select("slot", "prefix", "keys", "values")


def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    requests = _stream(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("client_id"), (o * 13 % 120).alias("seq"), o.alias("arrival"))
    folder = shared_folder(spark, "stream")
    sink = watch.deduplicated(requests).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def late_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes at or below a durable floor, which a stream refuses and reports."""
    folder = shared_folder(spark, "stream")
    accepted, late = watch.guard(_stream(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_partkey").alias("value")), 12_345, 500, folder)
    counted = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("slot").alias("least"), F.sum("value").alias("values"))
    return counted(accepted, "accepted").unionByName(counted(late, "late"))


QUERIES = {f.__name__: f for f in (watch_notify, dedup_window, late_writes)}

SQL = {
    "watch_notify": f"""WITH latest AS (SELECT slot, key, CASE WHEN is_delete THEN '' ELSE value::BIGINT::VARCHAR END AS text FROM (SELECT *, row_number() OVER (PARTITION BY slot, key ORDER BY seq DESC, is_delete DESC, value DESC) AS nth FROM ({LOG})) WHERE nth = 1)
SELECT slot, prefix, string_agg(key, ',' ORDER BY key) AS keys, string_agg(text, ',' ORDER BY key) AS "values" FROM latest JOIN (VALUES {', '.join(f"('{p}')" for p in PREFIXES)}) p(prefix) ON starts_with(key, prefix) GROUP BY 1, 2""",
    "late_writes": " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, min(l_orderkey) AS least, sum(l_partkey)::BIGINT AS \"values\" FROM lineitem WHERE l_orderkey {test} 12345" for kind, test in (("accepted", ">"), ("late", "<="))),
}
