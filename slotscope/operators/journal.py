"""The change journal: stretches of the log, its frontier and gaps, retention, replay and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotscope.functions.hashing import crc32c


class GapError(ValueError):
    """Slots below the retained log were asked for."""


def check_retained(log: DataFrame, min_slot: int, trim_slot: int) -> None:
    """Raises if the stretch begins below what retention has kept."""
    if min_slot < trim_slot:
        raise GapError(f"slots below {trim_slot} are trimmed; {min_slot} was asked for")


def journal_scan(log: DataFrame, min_slot: int, max_slot: int = 0, prefix: str = "", limit: int = 0, after: tuple[int, int] | None = None, trim_slot: int = 0) -> DataFrame:
    """Operations of [min_slot, max_slot] in log order, with truncated as the journal sets it: once the limit is reached.

    The cursor `after` is a slot and a place in its batch, so a page that ends within a batch loses nothing.
    """
    check_retained(log, min_slot, trim_slot)
    kept = log.where(F.col("slot") >= min_slot)
    kept = kept.where(F.col("slot") <= max_slot) if max_slot else kept
    kept = kept.where(F.col("key").startswith(prefix)) if prefix else kept
    if after:
        kept = kept.where((F.col("slot") > after[0]) | ((F.col("slot") == after[0]) & (F.col("seq") > after[1])))
    order = ("slot", "seq", "key", "is_delete", "value")
    if not limit:
        return kept.select(*order).withColumn("truncated", F.lit(False))
    page = kept.select(*order).orderBy(*order).limit(limit)
    return page.withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(0))) >= limit)


#: Levels of stretches that slots are looked at in; width to this power is far above any slot.
LEVELS = 4


def gaps(log: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Missing stretches (first, last) of slots from 1 to the tip.

    Gaps are found within stretches of `width` slots, in parallel; then, of stretches, first and last slots within stretches of `width` stretches, and so on. What is left
    to be looked at in one order are the ends of at most tip / width ** LEVELS stretches.
    """
    runs = log.where(F.col("slot") >= 1).select(F.col("slot").alias("first"), F.col("slot").alias("last")).distinct().withColumn("stretch", F.col("first"))
    found = None
    for _ in range(LEVELS):
        runs = runs.withColumn("stretch", F.expr(f"stretch div {width}"))
        before = F.lag("last").over(W.partitionBy("stretch").orderBy("first"))
        within = runs.select("first", before.alias("before"))
        found = within if found is None else found.unionByName(within)
        runs = runs.groupBy("stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ends = runs.select("first", F.coalesce(F.lag("last").over(W.orderBy("stretch")), F.lit(0)).alias("before"))
    return found.unionByName(ends).where(F.col("first") > F.col("before") + 1).select((F.col("before") + 1).alias("first_missing"), (F.col("first") - 1).alias("last_missing"))


def frontier(log: DataFrame, width: int = 1 << 14) -> DataFrame:
    """The highest slot up to which, from 1, none is missing; and the tip. 0 without slots."""
    tip = log.agg(F.greatest(F.lit(0), F.coalesce(F.max("slot"), F.lit(0))).alias("tip"))
    first = gaps(log, width).agg(F.min("first_missing").alias("first_missing"))
    return tip.crossJoin(first).select(F.coalesce(F.col("first_missing") - 1, F.col("tip")).alias("frontier"), "tip")  # one row each


def collect_garbage(resolved: DataFrame, snapshot_slot: int, safe_slot: int) -> DataFrame:
    """Resolved cells without tombstones at or below the floor min(snapshot_slot, safe_slot)."""
    return resolved.where(~(F.col("is_delete") & (F.col("slot") <= min(snapshot_slot, safe_slot))))


def segment_garbage(log: DataFrame, slots_each: int, gc_slot: int) -> DataFrame:
    """Log segments with what retention does: those whose highest slot is above 0 and strictly below gc_slot go."""
    segments = log.groupBy(F.floor(F.col("slot") / slots_each).alias("segment")).agg(F.max("slot").alias("max_slot"), F.count("*").alias("n_ops"))
    return segments.withColumn("removed", (F.col("max_slot") > 0) & (F.col("max_slot") < gc_slot))


def safe_slots(reports: DataFrame) -> DataFrame:
    """Per group and tenure round: the least applied slot of leader and voters, a missing one as 0; it never falls within a tenure."""
    least = reports.groupBy("group_id", "tenure", "round").agg(F.min(F.coalesce("applied", F.lit(0))).alias("least"))
    upto = W.partitionBy("group_id", "tenure").orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    return least.withColumn("safe_slot", F.max("least").over(upto)).drop("least")


def snapshot_watermarks(reports: DataFrame) -> DataFrame:
    """Per group: the lesser of the local durable slot and the highest of the voting peers'."""
    local = F.max(F.when(F.col("is_local"), F.col("durable")))
    peers = F.max(F.when(~F.col("is_local") & F.col("is_voter"), F.col("durable")))
    return reports.groupBy("group_id").agg(F.least(local, peers).alias("watermark"))


def checked(records: DataFrame) -> DataFrame:
    """records with ok: whether the payload's CRC-32C is the one that was stored."""
    return records.withColumn("ok", crc32c("payload") == F.col("checksum"))


def replay(records: DataFrame) -> DataFrame:
    """Per group from checked records (group_id, segment, position, kind, term, slot, voted_for, sealed, ok): what replay restores.

    A segment is read up to its first record that fails its check; what follows in it is cut off. In a sealed segment that isn't the group's last such
    a record raises: the group has to be rebuilt from its peers. The vote is the latest of the highest term.
    """
    last = records.groupBy("group_id").agg(F.max("segment").alias("last_segment"))
    bad = records.where(~F.col("ok")).groupBy("group_id", "segment").agg(F.min("position").alias("cut"))
    met = records.join(bad, ["group_id", "segment"], "left").join(last, "group_id")
    corrupt = F.col("cut").isNotNull() & F.col("sealed") & (F.col("segment") < F.col("last_segment"))
    error = F.concat(F.lit("corruption in sealed segment "), F.col("segment").cast("string"), F.lit(" of group "), F.col("group_id").cast("string"))
    good = met.withColumn("cut", F.when(corrupt, F.raise_error(error).cast("long")).otherwise(F.col("cut"))).where(F.col("cut").isNull() | (F.col("position") < F.col("cut")))
    vote = F.max(F.when(F.col("kind") == "vote", F.struct("term", "segment", "position", "voted_for")))
    found = good.groupBy("group_id").agg(F.max("term").alias("term"), F.count("*").alias("n_records"), F.max(F.when(F.col("kind") == "accepted", F.col("slot"))).alias("max_slot"), vote.alias("vote"))
    return found.select("group_id", "term", "n_records", "max_slot", F.when(F.col("vote.term") == F.col("term"), F.col("vote.voted_for")).alias("voted_for"))
