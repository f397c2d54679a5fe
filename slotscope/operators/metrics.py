"""Metric windows, latency histograms, reports and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in microseconds; the last bucket has none.
BOUNDS = (1, 10, 100, 500, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000)
#: What the last bucket is shown as.
NO_BOUND = 9_223_372_036_854_775_807
#: The precise histogram: values up to LINEAR are exact, above it each power of two has LINEAR parts; values are clamped to LARGEST.
LINEAR_BITS, LARGEST = 10, (1 << 32) - 1
QUANTILES = (0.5, 0.9, 0.99, 0.999)


def window_of(ts: Column, seconds: int) -> Column:
    """The start of the tumbling window, in seconds of the epoch."""
    return (F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("long")


def counters(samples: DataFrame, seconds: int) -> DataFrame:
    """Per metric and window: its count, the running total, and the rate per second, truncated."""
    counted = samples.groupBy("metric", window_of(F.col("ts"), seconds).alias("window")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("metric").orderBy("window").rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumn("total", F.sum("n").over(upto)).withColumn("tps", F.floor(F.col("n") / seconds).cast("long"))


def gauges(samples: DataFrame, seconds: int, order: str) -> DataFrame:
    """Per metric and window the last value."""
    return samples.groupBy("metric", window_of(F.col("ts"), seconds).alias("window")).agg(F.max_by("value", F.struct("ts", order)).alias("value"))


def summaries(samples: DataFrame, seconds: int) -> DataFrame:
    """Per metric and window: count, integer average (0 without samples), largest and sum."""
    n, total = F.count("value"), F.coalesce(F.sum("value"), F.lit(0))
    return samples.groupBy("metric", window_of(F.col("ts"), seconds).alias("window")).agg(n.alias("n"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("avg"), F.coalesce(F.max("value"), F.lit(0)).alias("max"), total.alias("total"))


def bandwidths(samples: DataFrame, seconds: int) -> DataFrame:
    """Per metric and window: transfers, integer average size and bytes per second, truncated."""
    n, total = F.count("value"), F.coalesce(F.sum("value"), F.lit(0))
    return samples.groupBy("metric", window_of(F.col("ts"), seconds).alias("window")).agg(n.alias("n"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("avg_size"), F.floor(total / seconds).cast("long").alias("rate"))


def deltas(readings: DataFrame) -> DataFrame:
    """Per series, the growth of a cumulative reading since the one before, 0 at least; none for the first."""
    before = F.lag("reading").over(W.partitionBy("series").orderBy("at"))
    return readings.withColumn("delta", F.when(before.isNotNull(), F.greatest(F.lit(0), F.col("reading") - before))).where(F.col("delta").isNotNull())


def fixed_bucket(value: Column) -> Column:
    """The bound of a value's bucket: the first that isn't below it."""
    found = F.lit(NO_BOUND)
    for b in reversed(BOUNDS):
        found = F.when(value <= b, F.lit(b)).otherwise(found)
    return found.cast("long")


def fixed_histogram(samples: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Per op: count, percentiles as bucket bounds and the highest bound in use.

    A percentile is the first bound whose running count reaches floor(n * p / 100). That target may be 0; the first bound
    reaches it, even without samples.
    """
    counted = samples.groupBy("op", fixed_bucket(F.col("micros")).alias("bound")).agg(F.count("*").alias("n"))
    every = F.explode(F.array(*[F.lit(b).cast("long") for b in (*BOUNDS, NO_BOUND)]))
    filled = counted.select("op").distinct().select("op", every.alias("bound")).join(counted, ["op", "bound"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = W.partitionBy("op").orderBy("bound").rowsBetween(W.unboundedPreceding, 0)
    running = filled.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy("op")))
    percentile = [F.min(F.when(F.col("upto") >= F.floor(F.col("total") * p / 100), F.col("bound"))).alias(f"p{p}") for p in percents]
    return running.groupBy("op").agg(F.max("total").alias("n"), *percentile, F.max(F.when(F.col("n") > 0, F.col("bound"))).alias("max_bound"))


def precise_bucket(value: Column) -> Column:
    """The lower bound of a value's part: itself up to 1023, then the value with all but its first eleven bits at 0."""
    v = F.greatest(F.lit(1), F.least(value, F.lit(LARGEST))).cast("long")
    size = F.length(F.bin(v)) - 1 - LINEAR_BITS
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), size).cast("int"))
    return v - v % width


def precise_histogram(samples: DataFrame, keys: tuple[str, ...] = ("op",), quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Per key: count, exact least, largest and mean, and quantiles as lower bounds of parts at rank ceil(q * n).

    Values are counted by part first, so what is shuffled is bounded by the number of parts, whatever the number of samples.
    """
    v = F.greatest(F.lit(1), F.least("micros", F.lit(LARGEST))).cast("long")
    parts = samples.groupBy(*keys, precise_bucket(F.col("micros")).alias("part")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.sum(v).alias("total"))
    upto = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    running = parts.withColumn("upto", F.sum("n").over(upto)).withColumn("whole", F.sum("n").over(W.partitionBy(*keys)))
    found = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("whole") * q)), F.col("part"))).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles]
    return running.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("min"), F.max("largest").alias("max"), (F.sum("total") / F.sum("n")).alias("mean"), *found)


def op_report(attempts: DataFrame) -> DataFrame:
    """Per op: attempts, outcomes, and latency quantiles of those that went well."""
    outcome = lambda v: F.count_if(F.col("outcome") == v)
    counts = attempts.groupBy("op").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") != "ok").alias("errors"), outcome("ok").alias("ok"), outcome("no_leader").alias("no_leader"), outcome("not_found").alias("not_found"), outcome("wrong").alias("correctness_errors"))
    return counts.join(precise_histogram(attempts.where(F.col("outcome") == "ok")).drop("n"), "op", "left")


def compare_reports(left: DataFrame, right: DataFrame, left_ms: int, right_ms: int) -> DataFrame:
    """Both runs' ok operations and operations a second, op by op; 0 without time or without the op."""
    def side(report: DataFrame, ms: int, name: str) -> DataFrame:
        qps = F.when(F.lit(ms) > 0, F.col("ok") / (ms / 1000)).otherwise(0.0) if ms else F.lit(0.0)
        return report.select("op", F.col("ok").alias(f"{name}_ok"), qps.alias(f"{name}_qps"))

    return side(left, left_ms, "left").join(side(right, right_ms, "right"), "op", "full").na.fill(0)


def cluster_metrics(per_node: DataFrame) -> DataFrame:
    """Nodes' counters and CPU added up; of memory and connections the largest."""
    return per_node.agg(F.sum("ops").alias("ops"), F.sum("cpu_ms").alias("cpu_ms"), F.max("rss_kb").alias("rss_kb"), F.max("tcp").alias("tcp"))


def round_trip(samples: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the integer moving average: the first sample, then three quarters of the old and a quarter of the new, each truncated.

    A fold in order; a key's samples are folded in one task, which state per key asks for.
    """
    step = lambda old, s: F.when(old == 0, s["micros"]).otherwise(F.floor(old / 4) * 3 + F.floor(s["micros"] / 4)).cast("long")
    folded = samples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "micros"))).alias("s"))
    return folded.select(key, F.aggregate("s", F.lit(0).cast("long"), step).alias("rtt"))


def parse_metrics_log(lines: DataFrame) -> DataFrame:
    """Numbers of a sectioned text log: (line_no, line) to (section, name, value); a line in brackets begins a section."""
    header = F.regexp_extract("line", r"^\[(\w+)\]\s*$", 1)
    in_section = F.last(F.when(header != "", header), ignorenulls=True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    fields = F.regexp_extract("line", r"^\s*([\w.]+)\s+count=(-?\d+)", 1), F.regexp_extract("line", r"^\s*([\w.]+)\s+count=(-?\d+)", 2)
    return lines.select("file", in_section.alias("section"), fields[0].alias("name"), fields[1].alias("value")).where("name != ''").withColumn("value", F.col("value").cast("long"))


def write_metrics_log(numbers: DataFrame, path: str) -> None:
    """The sectioned text log of (file, section, name, value), compressed, a folder a file; names without a count are left out."""
    active = numbers.where(F.col("value") != 0)
    lines = active.select("file", "section", F.lit(1).alias("kind"), "name", F.concat(F.lit("  "), "name", F.lit(" count="), F.col("value").cast("string")).alias("line"))
    heads = active.select("file", "section").distinct().select("file", "section", F.lit(0).alias("kind"), F.lit("").alias("name"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"))
    # the folder's name is a column of its own
    sorted_lines = lines.unionByName(heads).repartition("file").sortWithinPartitions("file", "section", "kind", "name")
    sorted_lines.select(F.col("file").alias("log"), "line").write.mode("append").partitionBy("log").option("compression", "gzip").text(path)


def read_metrics_log(spark, path: str) -> DataFrame:
    """The lines (file, line_no, line) of such logs; a file is read whole, as lines have no numbers of their own."""
    whole = spark.read.option("wholetext", True).text(path).select(F.concat_ws("/", F.col("log").cast("string"), F.col("_metadata.file_name")).alias("file"), F.split("value", "\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "line")).where("line != ''")


def log_totals(parsed: DataFrame) -> DataFrame:
    """Per section and name: window deltas added up, but the peak of what is absolute."""
    return parsed.groupBy("section", "name").agg(F.when(F.col("name") == "rss_kb", F.max("value")).otherwise(F.sum("value")).alias("value"))
