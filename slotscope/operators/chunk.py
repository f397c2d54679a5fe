"""Chunks of strips of segments: states, ranges, capacities, and trees of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Chunk states, and which commands they allow.
ACTIVE, SEALED, DELETED = "ACTIVE", "SEALED", "DELETED"


def may(command: str, state: Column) -> Column:
    return state.isin(ACTIVE, SEALED) if command == "delete" else state == ACTIVE


def next_state(state: Column, command: Column) -> Column:
    """The state after a command; one that isn't allowed changes nothing."""
    return F.when((command == "seal") & may("seal", state), SEALED).when((command == "delete") & may("delete", state), DELETED).otherwise(state)


def fold_commands(commands: DataFrame) -> DataFrame:
    """Per chunk: its state after all commands in order, how many were refused, and the bytes appended."""
    folded = commands.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "command", "bytes"))).alias("c"))
    begin = F.struct(F.lit(ACTIVE).alias("state"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("bytes"))

    def step(a: Column, c: Column) -> Column:
        allowed = F.when(c["command"] == "delete", may("delete", a["state"])).otherwise(may("append", a["state"]))
        return F.struct(next_state(a["state"], c["command"]).alias("state"), (a["refused"] + (~allowed).cast("long")).alias("refused"), (a["bytes"] + F.when(allowed & (c["command"] == "append"), c["bytes"]).otherwise(0)).alias("bytes"))

    return folded.select("chunk_id", F.aggregate("c", begin, step).alias("s")).select("chunk_id", "s.state", "s.refused", "s.bytes")


def chunks_of(strips: DataFrame) -> DataFrame:
    """Nested chunks from rows of strips; a strip's offset is the capacity of those before it."""
    before = F.sum("capacity").over(W.partitionBy("chunk_id").orderBy("strip_index").rowsBetween(W.unboundedPreceding, -1))
    placed = strips.withColumn("chunk_offset", F.coalesce(before, F.lit(0)).cast("long"))
    return placed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("strip_index", "capacity", "chunk_offset", "segments"))).alias("strips"))


def segments(chunks: DataFrame) -> DataFrame:
    """A row for each segment; a chunk without strips or a strip without segments keeps one, with nulls."""
    return chunks.select("chunk_id", F.explode_outer("strips").alias("s")).select("chunk_id", "s.strip_index", F.posexplode_outer("s.segments").alias("nth", "segment")).select("chunk_id", "strip_index", F.col("nth").cast("long").alias("segment_index"), "segment")


def capacity(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.aggregate("strips", F.lit(0).cast("long"), lambda a, s: a + s["capacity"]).alias("capacity"), F.size("strips").cast("long").alias("n_strips"))


def delete_range(chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """Chunks without the strips that overlap [offset, offset + length)."""
    end = offset + length
    return chunks.withColumn("strips", F.filter("strips", lambda s: ~((s["chunk_offset"] < end) & (s["chunk_offset"] + s["capacity"] > offset))))


def replace_strip(chunks: DataFrame, index: int, segments_: Column) -> DataFrame:
    """Chunks with the segments of the strip of an index replaced."""
    return chunks.withColumn("strips", F.transform("strips", lambda s: F.when(s["strip_index"] == index, s.withField("segments", segments_)).otherwise(s)))


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The children of parents that go."""
    return children.join(parents.select(key), key, "left_semi")


def flatten_config(config: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of JSON configs, however deep: a row for each value that isn't an object; a path's names are joined by dots. An empty object has no rows.

    Each round opens the objects of one level; there are as many rounds as the deepest config has levels.
    """
    parsed = config.select(key, F.lit("").alias("path"), F.parse_json(text).alias("value"))
    found, is_object = None, F.schema_of_variant("value").startswith("OBJECT")
    while True:
        leaves = parsed.where(~is_object).select(key, F.substring("path", 2, 1 << 20).alias("path"), F.col("value").try_cast("string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        opened = parsed.where(is_object)
        if not opened.head(1):
            return found
        names = F.variant_get("value", "$", "map<string,variant>")
        parsed = opened.select(key, "path", F.explode(names).alias("name", "inner")).select(key, F.concat("path", F.lit("."), "name").alias("path"), F.col("inner").alias("value"))


def config_diff(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Paths (of each key) that were added, removed or changed."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [*keys, "path"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"), "old", "new")
