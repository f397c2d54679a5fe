"""Reads of the versioned key-value log: highest slot wins, tombstones hide, pages are exact.

A log has the columns key, slot, seq, is_delete and value. Of a key's mutations the one of the highest slot wins, within a slot the
last; ties of both are settled by the whole row, so that no order of arrival decides. Versions are resolved before
deletes are dropped, never after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_bounds(key: Column, prefix: str) -> Column:
    """The prefix test together with the range it implies, which the Parquet reader can prune by."""
    if not prefix:
        return F.lit(True)
    test = key.startswith(prefix) & (key >= F.lit(prefix))
    last = prefix[-1]
    return test & (key < F.lit(prefix[:-1] + chr(ord(last) + 1))) if ord(last) < 0x7F else test


def resolve(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Each key's winning version, deletes included, as of a slot."""
    seen = log if as_of is None else log.where(F.col("slot") <= as_of)
    return seen.groupBy("key").agg(F.max(F.struct("slot", "seq", "is_delete", "value")).alias("cell")).select("key", "cell.slot", "cell.seq", "cell.is_delete", "cell.value")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return resolve(log, as_of).where(~F.col("is_delete")).select("key", "slot", "value")


def get(log: DataFrame, key: str) -> DataFrame:
    """The live version of one key, or no row. The key is filtered before versions are resolved."""
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """For each row of keys (ordinal, key), in any number, its live version or nulls."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(live(wanted), "key", "left").select("ordinal", "key", F.col("slot").isNotNull().alias("found"), "slot", "value")


def in_range(log: DataFrame, prefix: str = "", start_after: str | None = None, end_key: str | None = None) -> DataFrame:
    """Prefix and exclusive bounds on both ends."""
    kept = log.where(prefix_bounds(F.col("key"), prefix))
    if start_after is not None:
        kept = kept.where(F.col("key") > start_after)
    return kept if end_key is None else kept.where(F.col("key") < end_key)


def scan(log: DataFrame, prefix: str = "", start_after: str | None = None, end_key: str | None = None, limit: int = 0, as_of: int | None = None, keys_only: bool = False, tombstones: bool = False) -> DataFrame:
    """A page in key order. truncated says whether one more row matches: an exact fit is not truncated."""
    cells = resolve(in_range(log, prefix, start_after, end_key), as_of)
    cells = cells if tombstones else cells.where(~F.col("is_delete"))
    cells = cells.select("key", "slot", *(["is_delete"] if tombstones else []), *([] if keys_only else ["value"]))
    if not limit:
        return cells.withColumn("truncated", F.lit(False))
    # one row more than the page tells whether it is cut; both limits are of the page's size
    ahead = cells.orderBy("key").limit(limit + 1)
    place = W.orderBy("key")
    counted = ahead.withColumn("place", F.row_number().over(place)).withColumn("n", F.count("*").over(W.partitionBy(F.lit(0))))
    return counted.where(F.col("place") <= limit).withColumn("truncated", F.col("n") > limit).drop("place", "n")


def scan_count(log: DataFrame, prefix: str = "", limit: int = 0) -> DataFrame:
    """How many live keys match, up to limit."""
    n = live(in_range(log, prefix)).agg(F.count("*").alias("n"))
    return n.select((F.least("n", F.lit(limit)) if limit else F.col("n")).alias("n"))


def byte_budget_page(log: DataFrame, prefix: str, budget: int) -> DataFrame:
    """Live rows in key order while keys and values fit the budget; the first row always does.

    The running sum stands over as many rows as the budget can hold, each of which has the prefix's bytes and one more at least.
    """
    size = F.octet_length("key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    most_rows = budget // max(1, len(prefix.encode())) + 1
    upto = W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    ahead = live(in_range(log, prefix)).orderBy("key").limit(most_rows)
    return ahead.withColumn("bytes", F.sum(size).over(upto)).withColumn("place", F.row_number().over(W.orderBy("key"))).where((F.col("bytes") <= budget) | (F.col("place") == 1)).select("key", "slot", "value", F.col("bytes").cast("long").alias("bytes"))


def numbered(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """rows with place, from 0 in order of key, without sorting them in one task: ranges of keys are sorted apart and numbered on top of the ranges before.

    The sorted rows are written to folder, so that the ranges are the same when they are counted and when they are numbered.
    """
    sorted_rows = rows.repartitionByRange(key).sortWithinPartitions(key)
    sorted_rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")).write.parquet(folder)
    written = rows.sparkSession.read.parquet(folder)
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row a partition
    return written.join(F.broadcast(offsets), "part").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("before") + F.col("nth")).alias("place"))


def pages(log: DataFrame, limit: int, folder: str, as_of: int | None = None) -> DataFrame:
    """Every live key with its page of `limit` keys, as a cursor that goes on after each page's last key gives them; versions are resolved once."""
    return numbered(live(log, as_of).select("key"), "key", folder).select("key", F.expr(f"cast(place div {limit} AS int)").alias("page"))


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """Several logs as one: lowest key, then highest slot, then the first source, as in a merge of sorted runs."""
    tagged = [s.select("key", "slot", "is_delete", "value", F.lit(-i).alias("source")) for i, s in enumerate(sources)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("key").agg(F.max(F.struct("slot", "source", "is_delete", "value")).alias("c")).select("key", "c.slot", (-F.col("c.source")).alias("source"), "c.is_delete", "c.value")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys in which two resolved states differ, tombstones included; a slot that differs is reported before a value."""
    a, b = (s.select("key", *(F.col(c).alias(f"{n}_{c}") for c in ("slot", "is_delete", "value"))) for s, n in ((left, "left"), (right, "right")))
    kind = F.when(F.col("right_slot").isNull(), "ONLY_LEFT").when(F.col("left_slot").isNull(), "ONLY_RIGHT").when(F.col("left_slot") != F.col("right_slot"), "SLOT_DIFFERS").when(~(F.col("left_value").eqNullSafe(F.col("right_value")) & F.col("left_is_delete").eqNullSafe(F.col("right_is_delete"))), "VALUE_DIFFERS")
    return a.join(b, "key", "full").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("key", "kind", "left_slot", "right_slot")
