"""URL filters from dated lists, as a temporal list join in DataFrame operations alone.

A list's entries are dated: at a time a key (a host, or a domain with all below it) is listed in a category or
delisted. An entry holds until the key's next one, so the entries become validity intervals. Each capture is joined
with the intervals of its host and of every domain above it that hold at the time of its fetch.

Defined results: a URL without a host, or null, is matched by nothing; a null fetch time too; entries with a null key or
date are left out; of entries with the same key and date, delisting comes last and so holds; rows that repeat are judged each
for itself; other columns of the captures are kept, and may be named as the list's are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries up to which the list is broadcast; a longer one is joined by a shuffle.
BROADCAST_ENTRIES = 500_000


def host(url: Column) -> Column:
    """The lower-cased host: between the scheme's slashes and the next slash, question mark or hash; without user and port."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    return F.when(bare != "", F.regexp_replace(bare, r"\.$", ""))


def domains(name: Column) -> Column:
    """The host and every domain above it, itself first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [since, until) in which a key is listed in a category, from entries (key, dated, category; null: delisted)."""
    order = W.partitionBy("listed_key").orderBy("since", F.col("category").asc_nulls_last(), "category")
    named = entries.select(F.lower("key").alias("listed_key"), F.col("dated").alias("since"), "category").where("listed_key IS NOT NULL AND since IS NOT NULL")
    return named.withColumn("until", F.lead("since").over(order)).where("category IS NOT NULL AND (until IS NULL OR until > since)")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with url_host, blocked, and the most specific entry that held at the fetch: list_key, list_since, list_category."""
    intervals = validity(entries)
    intervals = F.broadcast(intervals) if intervals.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else intervals
    given = ("url_host", "blocked", "list_key", "list_since", "list_category")
    kept = F.struct(*(F.col(f"`{c}`") for c in captures.columns if c not in given))  # columns named as the results give way
    keyed = captures.select(kept.alias("capture"), host(F.col(url)).alias("url_host"), F.col(fetched).alias("capture_time"))
    # hosts and times alone are multiplied and looked up, each pair once; what holds for a pair then meets its captures
    tried = keyed.select("url_host", "capture_time").where("url_host IS NOT NULL AND capture_time IS NOT NULL").distinct().withColumn("tried_key", F.explode(domains(F.col("url_host"))))
    held = tried.join(intervals, (F.col("tried_key") == F.col("listed_key")) & (F.col("since") <= F.col("capture_time")) & (F.col("until").isNull() | (F.col("capture_time") < F.col("until"))))
    best = F.max(F.struct(F.length("listed_key").alias("n"), "listed_key", "since", "category"))
    judged = keyed.join(held.groupBy("url_host", "capture_time").agg(best.alias("best")), ["url_host", "capture_time"], "left")
    return judged.select("capture.*", "url_host", F.col("best").isNotNull().alias("blocked"), F.col("best.listed_key").alias("list_key"), F.col("best.since").alias("list_since"), F.col("best.category").alias("list_category"))
