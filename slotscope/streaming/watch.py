"""Streams of the log: prefix watches, bounded deduplication of clients' requests, and late writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests of a client that are remembered.
REMEMBERED = 64


def notifications(batch: DataFrame, prefixes: DataFrame) -> DataFrame:
    """A row for each slot and watched prefix that it touches, with the keys' latest values; a deleted key's is empty.

    Prefixes are matched by equal beginnings of each watched length, not by trying all pairs. The lengths are few and known from the watch list, which is
    bounded by its registry.
    """
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]
    begun = F.explode(F.array(*[F.left("key", F.lit(n)) for n in sorted(lengths)]))
    latest = batch.groupBy("slot", "key").agg(F.max(F.struct("seq", "is_delete", "value")).alias("c")).select("slot", "key", "c.is_delete", "c.value")
    touched = latest.select("slot", "key", F.when(F.col("is_delete"), "").otherwise(F.col("value").cast("string")).alias("text"), begun.alias("prefix")).join(prefixes, "prefix")
    each = touched.groupBy("slot", "prefix").agg(F.array_sort(F.collect_set(F.struct("key", "text"))).alias("k"))
    return each.select("slot", "prefix", F.array_join("k.key", ",").alias("keys"), F.array_join("k.text", ",").alias("values"))


def watch(stream: DataFrame, prefixes: DataFrame, out: str, checkpoint: str):
    """Runs the stream to what is there now and appends its notifications to out; a slot lies within one micro-batch or is notified in parts."""
    def each(batch: DataFrame, batch_id: int) -> None:
        notifications(batch, prefixes).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def first_seen(known: list[int], seqs: list[int]) -> tuple[list[int], list[bool]]:
    """Which requests are new among the last REMEMBERED different ones; one that is met again keeps its place."""
    window, new = list(known), []
    for s in seqs:
        fresh = s not in window
        new.append(fresh)
        if fresh:
            window.append(s)
            del window[:-REMEMBERED]
    return window, new


def deduplicated(requests: DataFrame) -> DataFrame:
    """A stream of (client_id, seq, arrival) with accepted; client 0 is never deduplicated. State is 64 numbers a client."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("arrival")
        known, new = first_seen(list(state.get[0]) if state.exists else [], rows["seq"].tolist())
        state.update((known,))
        yield rows.assign(accepted=[True] * len(rows) if key[0] == 0 else new)[["client_id", "seq", "arrival", "accepted"]]

    return requests.groupBy("client_id").applyInPandasWithState(step, "client_id long, seq long, arrival long, accepted boolean", "seqs array<long>", "append", GroupStateTimeout.NoTimeout)


def on_time(batch: DataFrame, durable_floor: int, allow_old: bool = False) -> DataFrame:
    """Writes above the durable floor; those at or below it come too late."""
    return batch if allow_old else batch.where(F.col("slot") > durable_floor)


def guard(stream: DataFrame, floor: int, open_slots: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of writes (slot, ...) to what is there now; those accepted, and those refused because they came too late.

    A write at or below the durable floor is refused and reported. What a micro-batch accepts is durable once it is written, and the floor then rises to
    `open_slots` below the highest accepted slot; it never falls. Floors are written with their batches, so a batch that runs again meets the same floor.
    """
    spark = stream.sparkSession
    floors = f"{folder}/floors"
    spark.createDataFrame([(-1, floor)], "batch long, floor long").write.parquet(floors)

    def each(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema("batch long, floor long").parquet(floors).where(F.col("batch") < batch_id).agg(F.max("floor")).first()[0]
        on_time(batch, known).write.mode("overwrite").parquet(f"{folder}/accepted/batch={batch_id}")
        batch.where(F.col("slot") <= known).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        top = spark.read.schema(batch.schema).parquet(f"{folder}/accepted/batch={batch_id}").agg(F.max("slot")).first()[0]
        spark.createDataFrame([(batch_id, known if top is None else max(known, top - open_slots))], "batch long, floor long").write.mode("append").parquet(floors)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = stream.schema.add("batch", "long")
    return tuple(spark.read.schema(kinds).parquet(f"{folder}/{kind}").drop("batch") for kind in ("accepted", "late"))


def check_applied(frontier: int, min_slot: int) -> None:
    """Raises where a read asks for more than is applied."""
    if frontier < min_slot:
        raise ValueError(f"slot {min_slot} isn't applied yet; the frontier is {frontier}")
