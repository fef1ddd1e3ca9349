"""The folder in which iterations cut their lineage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write to spark.checkpoint.dir; where that is unset, in local mode only, to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        import tempfile

        found = tempfile.mkdtemp(prefix="sieveworks-")
    context.setCheckpointDir(found)
