"""Allocation bitmaps as rows of (zone_id, bit), or of (zone_id, word, mask) with 64 bits a row: rebuilding, replay, compaction, and what views of a zone differ in.

Counts and set operations work on words. A record makes a row for each word that it touches, and words are dealt out over as many partitions as the
rows ask for, so a task's hash table has the same size whatever the input. Operators take either form, and records for what they set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Details that an integrity scan lists.
DETAILS = 256
#: Rows of words that a task groups, on average.
ROWS_A_TASK = 1 << 19


def bits(records: DataFrame) -> DataFrame:
    """Every bit that the records (zone_id, unit_offset, unit_count) cover, once; a record without units covers none."""
    return _spread(words(records))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of words as rows of bits."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1)
    return rows.select("zone_id", "word", F.explode(places).alias("place")).select("zone_id", (F.col("word") * 64 + F.col("place")).alias("bit"))


def _touched(view: DataFrame) -> DataFrame:
    """(zone_id, word, mask) of records or of rows of bits, a word as often as it is touched; rows of words stay as they are."""
    if "mask" in view.columns:
        return view.select("zone_id", "word", "mask")
    if "bit" in view.columns:
        return view.select("zone_id", F.expr("shiftright(bit, 6) AS word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT)) AS mask"))
    last = F.col("unit_offset") + F.col("unit_count") - 1
    span = view.where("unit_count > 0").select("zone_id", "unit_offset", last.alias("last")).withColumn("word", F.explode(F.sequence(F.expr("shiftright(unit_offset, 6)"), F.expr("shiftright(last, 6)"))))
    cut = span.select("zone_id", "word", F.greatest(F.col("unit_offset") - F.col("word") * 64, F.lit(0)).cast("int").alias("lo"), F.least(F.col("last") - F.col("word") * 64, F.lit(63)).cast("int").alias("hi"))
    return cut.select("zone_id", "word", F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (hi - lo)), lo) AS mask"))


def side_by_side(**views: DataFrame) -> DataFrame:
    """(zone_id, word) that any view touches, with a column of each view's mask: 0 where it has no bit there."""
    named = [v.select("zone_id", "word", *[(F.col("mask") if n == name else F.lit(None).cast("long")).alias(n) for n in views]) for name, v in ((name, _touched(v)) for name, v in views.items())]
    rows = reduce(DataFrame.unionByName, named)
    parts = 1 + sum(v.count() for v in views.values()) // ROWS_A_TASK
    return rows.repartition(parts, "zone_id", "word").groupBy("zone_id", "word").agg(*[F.coalesce(F.bit_or(n), F.lit(0).cast("long")).alias(n) for n in views])


def words(view: DataFrame) -> DataFrame:
    """(zone_id, word, mask), a row a word, of records or rows of bits."""
    return side_by_side(mask=view)


def counted(mask: Column) -> Column:
    return F.bit_count(mask).cast("long")


def summed(word: Column, mask: Column) -> Column:
    """The sum of a word's set bits: each bit of their places is counted with its worth."""
    having = [sum(1 << i for i in range(64) if i >> k & 1) for k in range(6)]
    return sum((counted(mask.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) * (1 << k) for k, m in enumerate(having)), word * 64 * counted(mask))


def popcount(records: DataFrame) -> DataFrame:
    """Set bits of each zone; where records overlap they count once."""
    return words(records).groupBy("zone_id").agg(F.sum(counted(F.col("mask"))).alias("used"))


def packed(view: DataFrame) -> DataFrame:
    """Per zone and stretch of 32,768 bits, as many as a block of the built-in bitmaps has, its count. Words are counted: such a block's 4 KB are never made."""
    return words(view).groupBy("zone_id", F.expr("word div 512").alias("stretch")).agg(F.sum(counted(F.col("mask"))).alias("used"))


def replayed(snapshot: DataFrame, log: DataFrame, slots: DataFrame) -> DataFrame:
    """Words of the snapshot with those of busy records put after its zone's slot; deletes are left to compaction.

    slots (zone_id, snapshot_slot) has a row for each zone with a snapshot, an empty one too; a zone without is replayed from the log's start.
    """
    since = F.col("snapshot_slot").isNull() | (F.col("stamp") > F.col("snapshot_slot"))
    later = log.where("is_busy").join(slots, "zone_id", "left").where(since)
    both = side_by_side(before=snapshot, after=later)
    return both.select("zone_id", "word", F.col("before").bitwiseOR(F.col("after")).alias("mask"))


def replay(snapshot: DataFrame, log: DataFrame, slots: DataFrame) -> DataFrame:
    """What replayed gives, as bits."""
    return _spread(replayed(snapshot, log, slots))


def compact(set_bits: DataFrame, freed: DataFrame, compacted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words without the bits freed after the zone's compaction stamp, and each zone's counts and new stamp; older frees are stale."""
    known = freed.join(compacted, "zone_id", "left").withColumn("fresh", F.col("stamp") > F.coalesce("compact_stamp", F.lit(0)))
    both = side_by_side(held=set_bits, gone=known.where("fresh"))
    left = both.select("zone_id", "word", F.expr("held & ~gone AS mask")).where("mask != 0")
    marks = known.groupBy("zone_id").agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"), F.greatest(F.max("stamp"), F.max(F.coalesce("compact_stamp", F.lit(0)))).alias("compact_stamp"))
    return left, marks


def compacted_zones(set_bits: DataFrame, left: DataFrame, marks: DataFrame, compacted: DataFrame) -> DataFrame:
    """Every zone with bits or frees: its bits left, fresh and stale frees and stamp. A zone compaction empties has 0 bits, one without frees keeps its stamp, or 0."""
    zones = set_bits.select("zone_id").union(marks.select("zone_id")).distinct()
    used = left.groupBy("zone_id").agg(F.sum(counted(F.col("mask"))).alias("used"))
    kept = compacted.select("zone_id", F.col("compact_stamp").alias("before"))
    found = zones.join(used, "zone_id", "left").join(marks, "zone_id", "left").join(kept, "zone_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("zone_id", count("used"), count("fresh"), count("stale"), F.coalesce("compact_stamp", "before", F.lit(0).cast("long")).alias("compact_stamp"))


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits of either view, of a alone and of one alone, for every zone that either view has a bit in."""
    total = lambda e: F.sum(counted(F.expr(e)))
    return side_by_side(a=a, b=b).groupBy("zone_id").agg(total("a | b").alias("united"), total("a & ~b").alias("cleared"), total("a ^ b").alias("differ"))


def ghosts(live: DataFrame, replayed: DataFrame, busy: DataFrame, free: DataFrame) -> DataFrame:
    """Words of bits in which two views differ, by kind: (zone_id, word, kind, mask). Records stand for all their bits, not for their first alone.

    Set only live: without any record a ghost_busy, with a free record alone a lag of compaction, with a busy record neither.
    Set only in the replay, with a busy record: a ghost_free.
    """
    both = side_by_side(l=live, r=replayed, b=busy, f=free)
    kinds = {"ghost_busy": "l & ~r & ~b & ~f", "uncompacted_lag": "l & ~r & ~b & f", "ghost_free": "r & ~l & b"}
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("mask")) for k, e in kinds.items()]))
    return both.select("zone_id", "word", found.alias("g")).select("zone_id", "word", "g.kind", "g.mask").where("mask != 0")


def drift(live: DataFrame, replayed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Zones' bit counts live and replayed; a zone rebuilt after a failed checksum always drifts."""
    both = side_by_side(live=live, replayed=replayed).groupBy("zone_id")
    totals = both.agg(F.sum(counted(F.col("live"))).alias("live"), F.sum(counted(F.col("replayed"))).alias("replayed"))
    marked = totals.join(fallback.select("zone_id", F.lit(True).alias("rebuilt")), "zone_id", "left")
    return marked.select("zone_id", "live", "replayed", (F.coalesce("rebuilt", F.lit(False)) | (F.col("live") != F.col("replayed"))).alias("drifts"))


def integrity(zones: DataFrame, records: DataFrame, capacity: int) -> DataFrame:
    """Counts of zones whose checksum fails, of records beyond the zone or without units, and of records of owner 0."""
    bad_zone = zones.agg(F.count_if(F.crc32("body") != F.col("checksum")).alias("corrupt_snapshots"))
    broken = (F.col("unit_count") <= 0) | (F.col("unit_offset") + F.col("unit_count") > capacity)
    return bad_zone.crossJoin(records.agg(F.count_if(broken).alias("corrupt_records"), F.count_if(F.col("owner") == 0).alias("zero_owner")))  # one row each


def integrity_details(zones: DataFrame, records: DataFrame, capacity: int, most: int = DETAILS) -> DataFrame:
    """What integrity counts, one by one: (kind, zone_id, unit_offset), the first `most` in order; of a snapshot the offset is -1."""
    snapshots = zones.where(F.crc32("body") != F.col("checksum")).select(F.lit("corrupt_snapshot").alias("kind"), "zone_id", F.lit(-1).cast("long").alias("unit_offset"))
    broken = (F.col("unit_count") <= 0) | (F.col("unit_offset") + F.col("unit_count") > capacity)
    named = lambda kind: records.where(broken if kind == "corrupt_record" else F.col("owner") == 0).select(F.lit(kind).alias("kind"), "zone_id", "unit_offset")
    return snapshots.unionByName(named("corrupt_record")).unionByName(named("zero_owner")).orderBy("kind", "zone_id", "unit_offset").limit(most)


def free_runs(records: DataFrame, capacity: int) -> DataFrame:
    """Stretches (first, length) of clear bits of each zone that has any bit set: what lies between a record and all that begin before it."""
    held = records.where("unit_count > 0").select("zone_id", "unit_offset", (F.col("unit_offset") + F.col("unit_count")).alias("end"))
    closed = held.unionByName(held.select("zone_id").distinct().select("zone_id", F.lit(capacity).cast("long").alias("unit_offset"), F.lit(capacity + 1).cast("long").alias("end")))
    order = W.partitionBy("zone_id").orderBy("unit_offset").rowsBetween(W.unboundedPreceding, -1)
    first = closed.select("zone_id", "unit_offset", F.coalesce(F.max("end").over(order), F.lit(0).cast("long")).alias("first"))
    return first.where("unit_offset > first").select("zone_id", "first", (F.col("unit_offset") - F.col("first")).alias("length"))


def first_fit(runs: DataFrame, units: int) -> DataFrame:
    """Each zone's first stretch that holds so many units."""
    return runs.where(F.col("length") >= units).groupBy("zone_id").agg(F.min("first").alias("unit_offset"))
