"""Queries over the run history.

Runs are ordered by timestamp, then run id. The last runs of each dataset are ranked with
``row_number() <= n``, for which Spark keeps only the best ``n`` rows of each dataset per
task before the shuffle, so one dataset holding most runs does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_history(
    runs: DataFrame, dataset_name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Runs oldest first, optionally of one dataset and only the last ``limit``."""
    if dataset_name:
        runs = runs.filter(F.col("dataset_name") == dataset_name)
    if limit:
        runs = runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(limit)
    return runs.orderBy("timestamp", "run_id")


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` runs of each dataset, with ``recency`` 1 for the newest."""
    newest = Window.partitionBy("dataset_name").orderBy(
        F.desc("timestamp"), F.desc("run_id")
    )
    return runs.withColumn("recency", F.row_number().over(newest)).filter(
        F.col("recency") <= n
    )


def score_trend(runs: DataFrame, n: int = 5) -> DataFrame:
    return recent_runs(runs, n).select("dataset_name", "timestamp", "quality_score")


def dataset_summary(runs: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """Runs, first and last run, and score mean, min, max and population std."""
    if dataset_name:
        runs = runs.filter(F.col("dataset_name") == dataset_name)
    return runs.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.min("timestamp").alias("first_run"),
        F.max("timestamp").alias("last_run"),
        F.avg("quality_score").alias("score_mean"),
        F.min("quality_score").alias("score_min"),
        F.max("quality_score").alias("score_max"),
        F.stddev_pop("quality_score").alias("score_std"),
    )


def history_status(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.max("timestamp").alias("last_updated")
    )


def dataset_names(runs: DataFrame) -> DataFrame:
    return runs.select("dataset_name").distinct()


def to_seconds(name: str) -> Column:
    """A timestamp as ``yyyy-MM-dd HH:mm:ss``.

    ``date_format`` would read a timestamp without time zone as local time and move the
    hour that daylight saving skips.
    """
    return F.substring(F.col(name).cast("string"), 1, 19).alias(name)


def run_table(runs: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """Runs for display: timestamp as text, score to two decimals (ties to even)."""
    if dataset_name:
        runs = runs.filter(F.col("dataset_name") == dataset_name)
    return runs.select(
        "run_id",
        "dataset_name",
        to_seconds("timestamp"),
        (F.rint(F.col("quality_score") * 100) / 100).alias("quality_score"),
        "rows",
        "columns",
        "status",
    )


def run_headline(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    return runs.select("run_id", "quality_score", "rows", "columns")
