"""Keeping a small intermediate result, safe against the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return tempfile.mkdtemp(prefix="plumbline-checkpoint-")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there from now on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
