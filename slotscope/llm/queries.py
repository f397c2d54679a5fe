"""The text operators' queries, with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotscope.llm.decontaminate import covered, decontaminate
from slotscope.llm.exact_dedup import exact_dedup
from slotscope.llm.labelled import fold
from slotscope.llm.language_model import language_model
from slotscope.llm.mixing import taken_words
from slotscope.llm.near_dedup import near_duplicates
from slotscope.llm.quality import quality
from slotscope.llm.repeats import remove_repeats
from slotscope.llm.shared import new_folder, table
from slotscope.llm.token_counts import token_counts
from slotscope.llm.toxicity import toxicity
from slotscope.llm.url_filter import url_filter


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).drop("uid")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_key", "stays")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85).drop("row_key", "stays")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.when(F.col("spans").isNull(), 0).otherwise(covered(F.col("spans"))).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Without a cache's path the cache is a new one."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache or new_folder(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity(docs, table(spark, sf_dir, "labels")).withColumnRenamed("toxic_score", "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_threshold", "toxic_flag")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The dated list that op9 applies (key, date, category; no category: delisted).
URL_LIST = (
    ("cheap-pills.example.com", "2024-01-01", "spam"),
    ("tionsh.example.net", "2024-02-10", "malware"),
    ("tionsh.example.net", "2024-04-01", None),
    ("tionsh.example.net", "2024-06-15", "phishing"),
    ("tionsh.example.net", "2024-09-01", None),
    ("tiontion.example.com", "2024-03-05", "adult"),
    ("blog.tiontion.example.com", "2024-05-20", "spam"),
    ("blog.tiontion.example.com", "2024-07-20", None),
    ("ththan.example.net", "2024-01-20", "spam"),
    ("ththan.example.net", "2024-08-08", "malware"),
    ("ththre.example.org", "2024-10-01", "phishing"),
    ("ththth.example.org", "2024-02-29", "adult"),
    ("ththth.example.org", "2024-03-01", None),
)

_listed = ",\n  ".join(f"('{k}', DATE '{d}', {'NULL' if c is None else repr(c)})" for k, d, c in URL_LIST)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; page p is taken as fetched p * 37 mod 366 days into 2024."""
    entries = spark.sql(f"SELECT * FROM VALUES {_listed} AS listed(key, dated, category)")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    found = url_filter(table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched")), entries)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return found.select("page_id", text("url_host").alias("url_host"), F.col("fetched").cast("string").alias("fetched"), "blocked", text("list_key").alias("list_key"), text("list_since").alias("list_since"), text("list_category").alias("list_category"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_url_filters": op9_url_filters,
    "op10_language_model": op10_language_model,
}

SQL = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS points FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM d""",
    "op5_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), found AS (
  SELECT doc_id, s, k, item_id FROM (
    SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS gram
    FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
  ) JOIN windows USING (k, gram)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
   item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
}

SQL["op9_url_filters"] = rf"""
WITH entries(key, since, category) AS (VALUES
  {_listed}
), intervals AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM entries) WHERE category IS NOT NULL
), captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '\.$', '') AS url_host
  FROM pages
), held AS (
  SELECT page_id, url_host, fetched, key, since, category, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC NULLS LAST) AS nth
  FROM captures LEFT JOIN intervals ON (url_host = key OR ends_with(url_host, '.' || key)) AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT page_id, url_host, fetched::VARCHAR AS fetched, key IS NOT NULL AS blocked, coalesce(key, '') AS list_key,
       coalesce(since::VARCHAR, '') AS list_since, coalesce(category, '') AS list_category
FROM held WHERE nth = 1"""
