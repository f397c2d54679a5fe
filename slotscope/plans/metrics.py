"""Metric windows, histograms and reports over the event table's latency samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.operators import metrics
from slotscope.sources.folders import shared_folder
from slotscope.sources.tables import latency_samples, table


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_samples(spark, sf_dir).select(F.col("op").alias("metric"), F.col("micros").alias("value"), "ts", "event_id")


def metric_counter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counters(_samples(spark, sf_dir), 3600)


def metric_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauges(_samples(spark, sf_dir), 3600, "event_id")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summaries(_samples(spark, sf_dir), 3600)


def metric_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bandwidths(_samples(spark, sf_dir), 600)


def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("at"), F.floor(F.col("value") * 10).cast("long").alias("reading"))
    return metrics.deltas(readings).select("series", "at", "delta")


def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active counters by name prefix, in order of name, with the label of their kind."""
    counted = _samples(spark, sf_dir).groupBy(F.concat(F.lit("op."), "metric").alias("name")).agg(F.count_if(F.col("value") > 300_000).alias("n"))
    return counted.where(F.col("name").startswith("op.") & (F.col("n") > 0)).withColumn("kind", F.lit("counter")).orderBy("name")


def hist_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fixed_histogram(latency_samples(spark, sf_dir))


def hist_fixed_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few samples an op, one op a user, type and day: percentiles whose target is 0 are the first bound."""
    op = F.concat_ws("/", "op", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return metrics.fixed_histogram(latency_samples(spark, sf_dir).withColumn("op", op))


def hist_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precise_histogram(latency_samples(spark, sf_dir))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    outcome = F.when(e % 31 == 0, "no_leader").when(e % 23 == 0, "not_found").when(e % 101 == 0, "wrong").otherwise("ok")
    return latency_samples(spark, sf_dir).withColumn("outcome", outcome)


def op_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.op_report(_attempts(spark, sf_dir))


def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir)
    left, right = metrics.op_report(a.where("event_id % 2 = 0 AND op <> 'view'")), metrics.op_report(a.where("event_id % 2 = 1 AND op <> 'error'"))
    return metrics.compare_reports(left, right, 10_000, 20_000)


def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per_node = e.groupBy((F.col("user_id") % 9).alias("node")).agg(F.count("*").alias("ops"), F.sum(F.floor("value")).cast("long").alias("cpu_ms"), F.max(F.floor(F.col("value") * 3)).cast("long").alias("rss_kb"), F.max("user_id").alias("tcp"))
    return metrics.cluster_metrics(per_node)


def rtt_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.round_trip(latency_samples(spark, sf_dir), "user_id", ["ts", "event_id"])


def metrics_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sectioned log, a file a user: every tenth event begins a section; others are counters of the section they stand in."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("["), "event_type", F.lit("]"))).otherwise(F.concat(F.lit("  "), F.when(F.col("event_id") % 10 == 9, "rss_kb").otherwise(F.col("event_type")), F.lit(" count="), F.floor("value").cast("string")))
    lines = e.select((F.col("user_id") % 7).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return metrics.log_totals(metrics.parse_metrics_log(lines).where("section IS NOT NULL"))


def metrics_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a metrics log that is written and read again."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("file"), F.col("event_type").alias("section"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("name")).agg(F.sum(F.floor("value")).cast("long").alias("value"))
    path = shared_folder(spark, "metrics-log")
    metrics.write_metrics_log(e, path)
    return metrics.log_totals(metrics.parse_metrics_log(metrics.read_metrics_log(spark, path)))


QUERIES = {f.__name__: f for f in (metric_counter_window, metric_gauge, metric_summary, metric_bandwidth, metric_delta, metric_names, hist_fixed, hist_fixed_small, hist_precise, op_report, report_compare, cluster_metrics, rtt_ewma, metrics_log_totals, metrics_log_sink)}

_E = "SELECT event_type AS op, event_type AS metric, greatest(1, floor(value * 1000))::BIGINT AS micros, greatest(1, floor(value * 1000))::BIGINT AS value, ts, event_id, user_id FROM events"


def _window(seconds: int) -> str:
    return f"(floor(epoch(ts) / {seconds}) * {seconds})::BIGINT AS \"window\""


_BOUND = "CASE " + " ".join(f"WHEN micros <= {b} THEN {b}" for b in metrics.BOUNDS) + f" ELSE {metrics.NO_BOUND} END"


def _fixed(op: str) -> str:
    every = ", ".join(f"({b}::BIGINT)" for b in (*metrics.BOUNDS, metrics.NO_BOUND))
    p = ", ".join(f"min(bound) FILTER (upto >= floor(total * {q} / 100)) AS p{q}" for q in (50, 90, 99))
    return f"""WITH c AS (SELECT {op} AS op, {_BOUND} AS bound, count(*) AS n FROM ({_E}) GROUP BY 1, 2),
f AS (SELECT o.op, b.bound, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT op FROM c) o CROSS JOIN (VALUES {every}) b(bound) LEFT JOIN c ON c.op = o.op AND c.bound = b.bound),
r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bound ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY op) AS total FROM f)
SELECT op, max(total)::BIGINT AS n, {p}, max(bound) FILTER (n > 0) AS max_bound FROM r GROUP BY op"""


_PART = "CASE WHEN micros < 1024 THEN micros ELSE (micros >> (floor(log2(micros))::INTEGER - 10)) << (floor(log2(micros))::INTEGER - 10) END"
_QUANTILES = ", ".join(f"quantile_disc({_PART}, {q}) AS {f'p{q * 100:g}'.replace('.', '_')}" for q in metrics.QUANTILES)
_A = f"SELECT *, CASE WHEN event_id % 31 = 0 THEN 'no_leader' WHEN event_id % 23 = 0 THEN 'not_found' WHEN event_id % 101 = 0 THEN 'wrong' ELSE 'ok' END AS outcome FROM ({_E})"

SQL = {
    "metrics_log_sink": "SELECT section, name, sum(value)::BIGINT AS value FROM (SELECT user_id % 7 AS file, event_type AS section, 'm' || event_id % 5 AS name, sum(floor(value))::BIGINT AS value FROM events GROUP BY 1, 2, 3) WHERE value <> 0 GROUP BY 1, 2",
    "metric_counter_window": f"SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY \"window\")::BIGINT AS total, n // 3600 AS tps FROM (SELECT metric, {_window(3600)}, count(*) AS n FROM ({_E}) GROUP BY 1, 2)",
    "metric_gauge": f"SELECT metric, {_window(3600)}, arg_max(value, (ts, event_id)) AS value FROM ({_E}) GROUP BY 1, 2",
    "metric_summary": f"SELECT metric, {_window(3600)}, count(*) AS n, (sum(value) // count(*))::BIGINT AS avg, max(value) AS max, sum(value)::BIGINT AS total FROM ({_E}) GROUP BY 1, 2",
    "metric_bandwidth": f"SELECT metric, {_window(600)}, count(*) AS n, (sum(value) // count(*))::BIGINT AS avg_size, (sum(value) // 600)::BIGINT AS rate FROM ({_E}) GROUP BY 1, 2",
    "metric_delta": "SELECT series, \"at\", delta FROM (SELECT user_id AS series, event_id AS \"at\", greatest(0, r - lag(r) OVER (PARTITION BY user_id ORDER BY event_id)) AS delta, lag(r) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT *, floor(value * 10)::BIGINT AS r FROM events)) WHERE b IS NOT NULL",
    "metric_names": f"SELECT 'op.' || metric AS name, count(*) FILTER (value > 300000) AS n, 'counter' AS kind FROM ({_E}) GROUP BY 1 HAVING count(*) FILTER (value > 300000) > 0",
    "hist_fixed": _fixed("op"),
    "hist_fixed_small": _fixed("op || '/' || user_id || '/' || strftime(ts, '%Y-%m-%d')"),
    "hist_precise": f"SELECT op, count(*) AS n, min(micros) AS min, max(micros) AS max, avg(micros) AS mean, {_QUANTILES} FROM ({_E}) GROUP BY op",
    "op_report": f"SELECT op, count(*) AS attempts, count(*) FILTER (outcome <> 'ok') AS errors, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'no_leader') AS no_leader, count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'wrong') AS correctness_errors, min(micros) FILTER (outcome = 'ok') AS min, max(micros) FILTER (outcome = 'ok') AS max, avg(micros) FILTER (outcome = 'ok') AS mean, " + ", ".join(f"quantile_disc({_PART}, {q}) FILTER (outcome = 'ok') AS {f'p{q * 100:g}'.replace('.', '_')}" for q in metrics.QUANTILES) + f" FROM ({_A}) GROUP BY op",
    "report_compare": f"SELECT op, coalesce(l, 0) AS left_ok, coalesce(l, 0) / 10.0 AS left_qps, coalesce(r, 0) AS right_ok, coalesce(r, 0) / 20.0 AS right_qps FROM (SELECT op, count(*) FILTER (outcome = 'ok') AS l FROM ({_A}) WHERE event_id % 2 = 0 AND op <> 'view' GROUP BY 1) FULL JOIN (SELECT op, count(*) FILTER (outcome = 'ok') AS r FROM ({_A}) WHERE event_id % 2 = 1 AND op <> 'error' GROUP BY 1) USING (op)",
    "cluster_metrics": "SELECT sum(ops)::BIGINT AS ops, sum(cpu_ms)::BIGINT AS cpu_ms, max(rss_kb) AS rss_kb, max(tcp) AS tcp FROM (SELECT count(*) AS ops, sum(floor(value))::BIGINT AS cpu_ms, max(floor(value * 3))::BIGINT AS rss_kb, max(user_id) AS tcp FROM events GROUP BY user_id % 9)",
    "rtt_ewma": f"SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(micros ORDER BY ts, event_id)), lambda a, x: CASE WHEN a = 0 THEN x ELSE (a // 4) * 3 + x // 4 END) AS rtt FROM ({_E}) GROUP BY 1",
    "metrics_log_totals": "WITH m AS (SELECT *, last_value(CASE WHEN event_id % 10 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id % 7 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) SELECT section, CASE WHEN event_id % 10 = 9 THEN 'rss_kb' ELSE event_type END AS name, CASE WHEN event_id % 10 = 9 THEN max(floor(value)) ELSE sum(floor(value)) END::BIGINT AS value FROM m WHERE event_id % 10 <> 0 AND section IS NOT NULL GROUP BY section, name, event_id % 10 = 9",
}
