"""The folder that all executors and the driver share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none (tests)."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        shared = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared.rstrip("/")
