"""What several text operators share: cutting lineage, sizing partitions and reading Arrow text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine if Spark runs in one process, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="slotscope-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: computed once, and kept where a lost executor doesn't matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/slotscope-{kind}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            delete_folder(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(forget)
    return path


def stash(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: compressed, and pruned by column when read."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_parts(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for work on df: the session's shuffle partitions, and more where df's bytes ask for them.

    Files count by their stored bytes. What was made from rows of the driver or from an RDD has no estimate; then
    the texts themselves are measured, and count for half.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    estimate = sum(sizes)
    if any(n >= 1 << 60 for n in sizes):
        texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
        estimate = (df.agg(F.sum(sum(texts, F.lit(16)))).first()[0] or 0) // 2
    return max(least, estimate // bytes_each)


class KeyFilter:
    """A Bloom filter of 64-bit hashes, of MOST_BITS at most: it never misses a key, and lets more others through the more keys it has."""

    MOST_BITS, BITS_A_KEY, SHIFTS = 1 << 26, 10, (0, 19, 38)

    def __init__(self, keys: DataFrame, column: str):
        bits = min(self.MOST_BITS, 1 << max(10, (self.BITS_A_KEY * keys.count()).bit_length()))
        places = keys.select(F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in self.SHIFTS))).alias("at"))
        found = places.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys, found = keys.view(np.uint64), np.ones(len(keys), bool)
        for s in self.SHIFTS:
            at = (keys >> np.uint64(s)) & np.uint64(64 * len(self.words) - 1)
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return found


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the offset at which each row begins (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most_bytes: int):
    """Row ranges [i, j) of at most most_bytes bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column):
    """Lower-cases A-Z alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_row(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of docs the rows whose doc_id and hash of (doc_id, text) are among rows (doc_id, row_key); of several that share both, the one whose columns hash smallest."""
    key, kept_id, kept = (free_name(docs, n) for n in ("kept_key", "kept_id", "kept_row"))
    named = rows.select(F.col("row_key").alias(key), F.col("doc_id").alias(kept_id)).distinct()
    keyed = docs.withColumn(kept, F.xxhash64("doc_id", "text"))
    met = keyed.join(named, (F.col(kept) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # hashes of maps aren't defined; such columns decide nothing
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    one = met.groupBy(F.col(kept).alias("k"), F.col("doc_id").alias("i")).agg(F.min_by(F.struct(*columns), hashed).alias("row"))
    return one.select("row.*")
