"""Table intake."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, source: str, format: str | None = None, **options: Any
) -> DataFrame:
    """A catalog table by name, or files by path (format defaults to parquet)."""
    if format is None and "/" not in source and os.sep not in source:
        return spark.read.table(source)
    return spark.read.format(format or "parquet").options(**options).load(source)


def from_pandas(spark: SparkSession, frame: Any, view: str | None = None) -> DataFrame:
    """A pandas frame as a DataFrame, optionally registered as a temporary view."""
    df = spark.createDataFrame(frame)
    if view is not None:
        df.createOrReplaceTempView(view)
    return df
