"""Token counts through a digest cache.

A text's digest and the tokenizer version's digest are the key of a stored count. Digests alone ask the cache; counts
that are there are joined. Of the texts that are missing, each distinct one is encoded once and its count appended. Only these
are shuffled, with what little a Bloom filter of their digests lets through besides, and map tasks drop their own
repeats before, so that a text with any number of copies sends one row a task. Where nothing is missing, no text is read again.

Defined results: null text counts as empty and has no tokens; every row gives a row, repeated rows and null ids too;
no rows give no rows and an unchanged cache; a cache that isn't there yet, or is an empty folder, is an empty one; what an append that
was cut short left behind isn't read; other columns are not read.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotscope.llm.shared import KeyFilter, n_parts, stash, utf8_column

#: Characters of text that are encoded together.
BATCH_CHARS = 1 << 20
COUNTS = "digest binary, version string, n_tokens long"


def digest(text):
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def tokenizer_version(model_path: str) -> str:
    """A digest of everything that decides a count: the model's bytes, the library and the way it is called."""
    called = f"sentencepiece {sentencepiece.__version__} encode, nothing added"
    return hashlib.sha256(Path(model_path).read_bytes() + called.encode()).hexdigest()


def _distinct_texts(wanted):
    """A task's distinct texts whose keys the filter lets through, compressed, with their digests."""

    def distinct(batches):
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.has(batch.column("key").to_numpy())))
            data, offsets = utf8_column(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            digests, bodies = [], []
            for key, i, j in zip(batch.column("digest").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if key not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(key)
                    digests.append(key)
                    bodies.append(squeeze.compress(view[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

    return distinct


def _encode(model, version: str):
    def encode(batches):
        coder = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        open_up = zstandard.ZstdDecompressor()
        seen: set[bytes] = set()
        for batch in batches:
            digests, counts, waiting, held = [], [], [], 0
            for key, body in zip(batch.column("digest"), batch.column("body"), strict=True):
                if (k := key.as_py()) in seen:
                    continue
                seen.add(k)
                digests.append(k)
                waiting.append(open_up.decompress(body.as_py()).decode())
                held += len(waiting[-1])
                if held > BATCH_CHARS:
                    counts += [len(x) for x in coder.encode(waiting, num_threads=1)]
                    waiting, held = [], 0
            counts += [len(x) for x in coder.encode(waiting, num_threads=1)] if waiting else []
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(digests), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return encode


def stored(spark, cache: str, version: str) -> DataFrame:
    """The cache's counts for a tokenizer version; empty where the cache isn't there yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    counts = spark.read.schema(COUNTS).parquet(cache) if there else spark.createDataFrame([], COUNTS)
    return counts.where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def token_counts(docs: DataFrame, model_path: str, cache: str) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, digest. Appends the counts of texts not met before to the cache."""
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    key = F.xxhash64("digest").alias("key")
    keyed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(F.col("text")).alias("digest"))
    misses = stash(keyed.select("digest").distinct().join(stored(spark, cache, version).select("digest"), "digest", "left_anti"), "misses")
    if misses.head(1):
        model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
        wanted = spark.sparkContext.broadcast(KeyFilter(misses.select(key), "key"))
        texts = docs.select("text", digest(F.col("text")).alias("digest")).select("text", "digest", key).mapInArrow(_distinct_texts(wanted), "digest binary, body binary")
        missed = texts.repartition(n_parts(docs), "digest").join(misses, "digest", "left_semi")
        missed.mapInArrow(_encode(model, version), COUNTS).write.mode("append").parquet(cache)
    # many copies make a hot key: met by another key than the counts are made distinct by, both sides are shuffled anew and Spark can split them
    counts = stored(spark, cache, version).select(F.hex("digest").alias("met"), "n_tokens")
    return keyed.withColumn("met", F.hex("digest")).join(counts, "met").select("doc_id", "n_bytes", "n_tokens", "digest")
