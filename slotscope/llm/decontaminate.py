"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

An item's windows are its runs of `size` consecutive words (a shorter item is one window). Containment is exact, so
one token of each window is its necessary prefix: the one rarest in the documents. Documents are joined on those
tokens alone; length and position bound the place a window could take, and there its words are compared.

Defined results: null text has no words; an item without words has no windows; a null item_id is named "null";
rows that repeat a doc_id with another text are judged each for itself; no benchmark rows give no hits; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotscope.llm.shared import ascii_lower, cut, free_name

#: What parts words: every ASCII character but digits and letters. They are named one by one, for which Java's regular
#: expressions look a character up in a table; from ranges they would try one after the other.
PARTING = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{PARTING}]+"
#: Windows up to which the benchmark's side is broadcast; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD), F.lit(0))


def bounded(small: DataFrame, rows: int, most: int) -> DataFrame:
    """small to be broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(small) if rows <= most else small


def item_windows(benchmark: DataFrame, docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """A row for each distinct window that could occur: its words, its rarest token and where that stands, its items; and the row count."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = cut(items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")))
    n = windows.count()
    tokens = windows.select(F.explode("window").alias("token")).distinct()
    counts = docs.select(F.explode(words("text")).alias("token")).join(bounded(tokens, n, BROADCAST_WINDOWS), "token", "left_semi").groupBy("token").agg(F.count("*").alias("uses"))
    placed = windows.select("window", "items", F.posexplode("window").alias("place", "token"))
    # a token that no document uses leaves its window out: the inner join finds fewer tokens than the window has
    rarest = (
        placed.join(counts, "token")
        .groupBy("window")
        .agg(F.first("items").alias("items"), F.count("*").alias("found"), F.min(F.struct("uses", "token", "place")).alias("rare"))
        .where(F.col("found") == F.size("window"))
        .select("window", "items", F.size("window").alias("n_window"), F.col("rare.token").alias("token"), F.col("rare.place").alias("place"))
    )
    return cut(rarest), n


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row for each document with occurring windows: doc_id, row_key, spans (start, end of each, in words), items."""
    windows, n = item_windows(benchmark, docs, size)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words("text").alias("w"))
    start = F.col("at") - F.col("place")
    if n <= BROADCAST_WINDOWS:
        placed = keyed.select("doc_id", "row_key", "w", F.posexplode_outer("w").alias("at", "token"))
        found = (
            placed.join(F.broadcast(windows), "token")
            .where((start >= 0) & (start + F.col("n_window") <= F.size("w")))
            .where(F.slice("w", start + 1, F.col("n_window")) == F.col("window"))
            .groupBy("doc_id", "row_key")
            .agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("n_window")).alias("end"), "items")).alias("hit"))
        )
    else:
        # without the words, which a shuffle would carry once a token; places are verified where they meet the words again
        placed = keyed.select("doc_id", "row_key", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "token"))
        near = placed.join(windows, "token").where((start >= 0) & (start + F.col("n_window") <= F.col("n")))
        near = near.groupBy("row_key", F.col("doc_id").alias("near_id")).agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("n_window")).alias("end"), "items", "window")).alias("hit"))
        met = near.join(keyed, "row_key").where(F.col("near_id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["row_key", "doc_id"])
        found = met.withColumn("hit", F.filter("hit", lambda h: F.slice("w", h["start"] + 1, h["end"] - h["start"]) == h["window"])).where(F.size("hit") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("hit", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))))
    return found.select("doc_id", "row_key", spans.alias("spans"), F.array_distinct(F.flatten("hit.items")).alias("items"))


def covered(spans: Column) -> Column:
    """How many words the sorted spans cover."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, begin, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row for each document: doc_id, row_key, n_words, spans, items (both null without hits)."""
    counted = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    found = hits(docs, benchmark, size).withColumnsRenamed({"doc_id": "hit_id", "row_key": "hit_key"})
    return counted.join(found, (F.col("row_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").drop("hit_id", "hit_key")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without those in which a window occurs."""
    key, hit_key, hit_id = (free_name(docs, n) for n in ("row_key", "hit_key", "hit_id"))
    found = hits(docs, benchmark, size).select(F.col("doc_id").alias(hit_id), F.col("row_key").alias(hit_key))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return keyed.join(found, (F.col(key) == F.col(hit_key)) & F.col("doc_id").eqNullSafe(F.col(hit_id)), "left_anti").drop(key)
