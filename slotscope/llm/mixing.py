"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations alone.

Every source's documents are dealt into blocks by a hash. Its target, in words, gives each of its blocks whole copies
and, for the rest, the first blocks of a permutation, the last of them in part. These exact block quotas are split
down a binary tree over the output shards: a node's left half gets a multivariate-hypergeometric draw of the
node's quotas. Shards then take disjoint stretches of each source's permuted blocks and shuffle their documents.

Blocks have BLOCK_DOCS documents on average, however many a source has, so there are always more of them than shards. A permutation
is the order of hashes, cut into slices of equal hash ranges: sums run within slices, on top of the sums of the slices
before, so a source that holds most documents isn't ordered in one task. From its first levels on the tree is
dealt out by nodes. A node only has the sources that still have quotas in it, and where their stretches begin.

Defined results: null text has size 0; null is a source of its own, the last; documents of size 0 are taken as often
as their block is, with no words; rows that repeat are documents of their own; no rows give no rows; a source
without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotscope.llm.shared import cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents of a block and blocks of a slice, on average; words of a shard.
BLOCK_DOCS, SLICE_BLOCKS = 256, 4096
SHARD_WORDS = 250_000
#: Levels of the tree after which its nodes are dealt out anew.
DEALT_LEVELS = 8
#: Sources up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, uid (of the row), the hash that orders documents, and one of all columns; cut, so that texts are read once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), row_hash(docs).alias("row_hash"), F.monotonically_increasing_id().alias("uid")))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but maps, whose hashes aren't defined."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))


def source_targets(slim: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: sid (its place by code point, null last), source_size, n_docs, target.

    Targets share out share times all sizes by weight; one stops at most times its source's size and the excess goes
    to the others by weight. Sources stand in the order in which a rising level reaches their stops; the level
    at which the first of them isn't reached is the highest that the running sums give.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    reached = W.partitionBy(F.lit(0)).orderBy("stop_level", "sid")
    before = reached.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    return (
        slim.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        .withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("weight", weight)
        .withColumn("stop", most * F.col("source_size"))
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        .withColumn("left_words", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left_words") / F.col("left_weight")).over(everything))
        .select("source", "sid", "source_size", "n_docs", F.least("stop", F.col("level") * F.col("weight")).alias("target"))
    )


def uniform(*columns) -> Column:
    """A fixed pseudo-random number in [0, 1) for the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`: the distribution's inverse at u.

    The weights are summed over twelve standard deviations about the mean; what lies beyond is less than a double resolves.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    spread = 12 * F.sqrt(F.when(n > 1, F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / (n - 1))).otherwise(0.0)) + 2
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - spread).cast("double")).cast("long")
    high = F.least(k, d, F.ceil(mean + spread).cast("double")).cast("long")

    def ratio(x: Column) -> Column:
        """Weight of x + 1 over that of x."""
        return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    steps = F.sequence(low, F.greatest(low, high))
    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["w"] * F.when(x < high, ratio(x)).otherwise(0.0)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])
    start = F.struct(F.lit(1.0).alias("w"), (u * whole).alias("left"), low.alias("x"))
    step = lambda a, x: F.struct((a["w"] * F.when(x < high, ratio(x)).otherwise(0.0)).alias("w"), (a["left"] - a["w"]).alias("left"), F.when((a["left"] >= a["w"]) & (x < high), x + 1).otherwise(a["x"]).alias("x"))
    return F.aggregate(steps, start, step, lambda a: a["x"])


def place_in_order(*columns) -> Column:
    """A hash of the columns, of 0 or more, by which they are permuted."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def slice_of(place: Column, n_slices: Column) -> Column:
    return F.floor(F.shiftrightunsigned(place, 10) / F.lit(float(1 << 53)) * n_slices).cast("long")


def summed_before(rows: DataFrame, value: Column, ties: list[str]) -> DataFrame:
    """rows with upto, the sum of value over a source's rows up to each in the order of place; slices (ordered as places are) are summed apart."""
    within = W.partitionBy("sid", "slice").orderBy("place", *ties).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("sid").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = rows.groupBy("sid", "slice").agg(F.sum(value).alias("slice_sum")).select("sid", "slice", F.coalesce(F.sum("slice_sum").over(before), F.lit(0)).alias("slices_before"))
    return rows.withColumn("upto", F.sum(value).over(within)).join(slices, ["sid", "slice"]).withColumn("upto", F.col("upto") + F.col("slices_before")).drop("slices_before")


def split(lo: Column, hi: Column, quotas: Column, seed: int) -> Column:
    """The left half's quotas: a multivariate-hypergeometric draw, source after source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["n"])
    drawn = F.floor(total * F.floor((hi - lo) / 2) / (hi - lo)).cast("long")
    start = F.struct(total.alias("n"), drawn.alias("d"), F.array().cast("array<long>").alias("got"))

    def step(a: Column, q: Column) -> Column:
        x = hypergeometric(uniform(F.lit(seed), lo, hi, q["sid"]), a["n"], q["n"], a["d"])
        return F.struct((a["n"] - q["n"]).alias("n"), (a["d"] - F.element_at(F.array(x), 1)).alias("d"), F.concat(a["got"], F.array(x)).alias("got"))

    return F.aggregate(quotas, start, step, lambda a: a["got"])


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """sid, shard, first, n_blocks: the stretch of its source's permuted blocks that each shard takes, from sid, quota. Sources without blocks in a shard have no row."""
    whole = quotas.where("quota > 0").select(F.struct("sid", F.col("quota").cast("long").alias("n"), F.lit(0).cast("long").alias("first")).alias("s"))
    nodes = whole.agg(F.array_sort(F.collect_list("s")).alias("q")).select(F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"), "q")
    least = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entry = lambda q, n, first: F.struct(q["sid"].alias("sid"), n.alias("n"), first.alias("first"))
    for level in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        if level and level % DEALT_LEVELS == 0:
            nodes = nodes.repartition(min(1 << level, max(least, n_shards >> 12)), "lo")
        lo, hi, q = F.col("lo"), F.col("hi"), F.col("q")
        mid = lo + F.floor((hi - lo) / 2)
        nodes = nodes.withColumn("left", F.when(hi - lo > 1, split(lo, hi, q, seed)).otherwise(F.transform(q, lambda s: s["n"])))
        some = lambda halves: F.filter(halves, lambda s: s["n"] > 0)
        left = some(F.zip_with(q, "left", lambda s, n: entry(s, n, s["first"])))
        right = some(F.zip_with(q, "left", lambda s, n: entry(s, s["n"] - n, s["first"] + n)))
        halves = F.when(hi - lo > 1, F.array(F.struct(lo.alias("lo"), mid.alias("hi"), left.alias("q")), F.struct(mid.alias("lo"), hi.alias("hi"), right.alias("q")))).otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi"), q.alias("q"))))
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.lo", "n.hi", "n.q")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("s")).select("s.sid", "shard", "s.first", F.col("s.n").alias("n_blocks"))


def mix(slim: DataFrame, targets: DataFrame, n_sources: int, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each taken copy: uid, h, row_hash, doc_id, size, sid, block, copy, shard, and its position in the shuffled shard."""
    known = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    dealt = (
        slim.join(known, slim.source.eqNullSafe(known.source))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_DOCS)))
        .withColumn("block", F.pmod("h", "n_blocks"))
        .withColumn("n_slices", F.ceil(F.col("n_blocks") / SLICE_BLOCKS))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("uid", "h", "row_hash", "doc_id", "size", "sid", "block", "n_slices", "whole", "rest")
    )
    place = place_in_order(F.lit(seed), "sid", "block")
    found = (
        dealt.groupBy("sid", "block")
        .agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("n_slices").alias("n_slices"))
        .withColumn("place", place)
        .withColumn("slice", slice_of(F.col("place"), F.col("n_slices")))
    )
    blocks = cut(
        summed_before(found, F.col("words"), ["block"])
        .withColumn("room", F.col("rest") - (F.col("upto") - F.col("words")))
        .withColumn("copies", F.col("whole") + (F.col("room") > 0).cast("long"))
        .select("sid", "block", "words", "whole", "room", "copies", "n_slices")
    )
    wanted = blocks.agg(F.sum(F.col("whole") * F.col("words") + F.greatest(F.lit(0.0), F.least("room", "words")))).first()[0] or 0
    shards = shard_quotas(blocks.groupBy("sid").agg(F.sum("copies").alias("quota")), max(1, math.ceil(wanted / shard_words)), seed)
    places = shards.select("sid", "shard", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n_blocks"))).alias("rank"))
    tickets = blocks.where("copies > 0").select("sid", "block", "whole", "room", "n_slices", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    tickets = tickets.withColumn("place", place_in_order(F.lit(seed + 1), "sid", "block", "copy")).withColumn("slice", slice_of(F.col("place"), F.col("n_slices")))
    tickets = summed_before(tickets, F.lit(1).cast("long"), ["block", "copy"]).withColumnRenamed("upto", "rank")
    drawn = tickets.join(places, ["sid", "rank"]).select("sid", "block", "copy", "shard", "room", (F.col("copy") > F.col("whole")).alias("partial"))
    within = W.partitionBy("sid", "block").orderBy("h", "uid").rowsBetween(W.unboundedPreceding, 0)
    ordered = dealt.select("uid", "h", "row_hash", "doc_id", "size", "sid", "block", (F.sum("size").over(within) - F.col("size") / 2).alias("middle"))
    taken = ordered.join(drawn, ["sid", "block"]).where(~F.col("partial") | (F.col("middle") <= F.col("room")))
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "h", "copy"), "uid", "copy")
    return taken.select("uid", "h", "row_hash", "doc_id", "size", "sid", "block", "copy", "shard", F.row_number().over(shuffled).alias("position"))


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized documents, the sources' targets and the taken copies."""
    slim = sized(docs, seed)
    targets = cut(source_targets(slim, share, most))
    return slim, targets, mix(slim, targets, targets.count(), seed)


def taken_words(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, copies, the shards of its copies (comma-joined, by copy), uid."""
    slim, targets, copies = mix_documents(docs, share, most, seed)
    known = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    by_copy = F.array_sort(F.collect_list(F.struct("copy", "shard")))  # a row has as many copies as its source is repeated
    per_doc = copies.groupBy("uid").agg(F.count("*").alias("copies"), F.array_join(F.transform(by_copy, lambda c: c["shard"].cast("string")), ",").alias("shards"))
    joined = slim.join(known.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).join(per_doc, "uid", "left")
    n = F.coalesce("copies", F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), F.coalesce("shards", F.lit("")).alias("shards"), "uid")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs, each row as often as the mix takes it, with mix_copy, mix_shard and mix_position."""
    docs = docs.drop("mix_copy", "mix_shard", "mix_position")  # columns of these names give way
    _, _, copies = mix_documents(docs, share, most, seed)
    key, key_id, place_key = (free_name(docs, n) for n in ("mix_key", "mix_id", "mix_place"))
    places = copies.select(F.col("row_hash").alias(place_key), F.col("doc_id").alias(key_id), F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"), F.col("position").alias("mix_position"))
    # rows that repeat in all columns have one key; each of them has copies of its own among the places
    texts = docs.withColumn(key, row_hash(docs)).dropDuplicates([key, "doc_id"])
    met = texts.join(places, (F.col(key) == F.col(place_key)) & F.col("doc_id").eqNullSafe(F.col(key_id)))
    return met.drop(key, key_id, place_key)
