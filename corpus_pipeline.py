"""A corpus from raw documents: toxic texts go, copies and near copies go, benchmark passages go, sources are mixed.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept; what it returns is written as Parquet and read
again for the next. The last one returns a row for each copy that the mix takes, with its shard and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotscope.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from slotscope.llm.shared import new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go; the classifier learns from labels outside the held-out fold."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("NOT toxic_flag").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that is linked by a similarity of 0.8 on five-word shingles, one document stays."""
    return near_dedup.keep_one(docs, n_words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

#: Scores of a trained network, MinHash candidates and hash-permuted draws aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
