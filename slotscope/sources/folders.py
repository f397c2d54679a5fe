"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path within spark.checkpoint.dir. Where that is unset, on this machine if Spark runs in one process, as in tests; else an error."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix=f"slotscope-{kind}-")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
