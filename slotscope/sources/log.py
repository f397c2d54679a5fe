"""The log as a table of its own: appends of puts, deletes and batches, and decoded system records."""

from __future__ import annotations

from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "key string, slot long, seq int, is_delete boolean, value double"


def append(batch: DataFrame, path: str) -> None:
    """Appends one commit: all its rows become visible together. Rows of one slot are one batch, in order of seq; the last of a key wins."""
    batch.select("key", F.col("slot").cast("long").alias("slot"), F.col("seq").cast("int").alias("seq"), "is_delete", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


class Commit:
    """Puts and deletes of a client, gathered and appended together at the end of a with block, or earlier once there are `most` of them.

    A block that raises appends nothing of what is still gathered.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 10_000):
        self.spark, self.path, self.most = spark, path, most
        self.rows: list[tuple] = []

    def put(self, slot: int, key: str, value: float) -> None:
        self._add(slot, key, False, value)

    def delete(self, slot: int, key: str) -> None:
        self._add(slot, key, True, None)

    def _add(self, slot: int, key: str, is_delete: bool, value: float | None) -> None:
        seq = sum(r[1] == slot for r in self.rows[-1:]) and self.rows[-1][2] + 1
        if not seq and len(self.rows) >= self.most:  # never within a slot
            self.flush()
        self.rows.append((key, slot, seq, is_delete, value))

    def flush(self) -> None:
        if self.rows:
            append(self.spark.createDataFrame(self.rows, LOG), self.path)
        self.rows = []

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind is None:
            self.flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def decode_records(records: DataFrame, schema: str) -> DataFrame:
    """JSON values as columns; one that can't be read fails the query."""
    return records.withColumn("record", F.from_json("value", schema, {"mode": "FAILFAST"})).select("key", "record.*")


def write_operations(operations: DataFrame, path: str) -> None:
    """An operations log: a JSON object a line, compressed."""
    operations.write.mode("append").option("compression", "gzip").json(path)
