"""Faulted views of the given tables, so that checks have something to find.

The tables are clean; the views spoil a fixed share of their cells by key. They cover
every row, and their SQL twins are in :mod:`plumbline.catalog.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_f(spark: SparkSession, folder: str) -> DataFrame:
    """Missing names and balances, empty segments, absurd balances."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 10 != 0, F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(key % 100 == 7, F.lit(2e10))
        .when(key % 40 != 3, F.col("c_acctbal"))
        .alias("c_acctbal"),
        F.when(key % 25 == 1, F.lit(""))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


def mail_f(spark: SparkSession, folder: str) -> DataFrame:
    """Mail made of customers, with bad addresses, spam and impossible sentiments."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.when(key % 40 == 1, F.lit(None))
        .when(key % 30 == 0, F.lit("invalid-email"))
        .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")))
        .alias("sender_email"),
        F.when(key % 20 == 5, F.lit(None))
        .when(key % 50 == 2, F.lit("urgent!!! act fast"))
        .otherwise(F.concat(F.lit("Meeting "), key.cast("string")))
        .alias("subject"),
        F.when(key % 50 == 4, F.lit(2.5))
        .otherwise(F.col("c_acctbal") / 10000.0)
        .alias("sentiment_score"),
        F.col("c_name").alias("email_content"),
    )


def events_f(spark: SparkSession, folder: str) -> DataFrame:
    """Some events twice, some without a value."""
    return faulted_events(table(spark, folder, "events"))


def events_f_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream."""
    schema = table(spark, folder, "events").schema
    # a file stream takes a single file only by pattern; a folder of files matches too
    events = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    return faulted_events(events)


def faulted_events(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    copies = F.when(key % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        events.withColumn("value", F.when(key % 20 != 3, F.col("value")))
        .withColumn("copy", F.explode(copies))
        .drop("copy")
    )


def runs_f(spark: SparkSession, folder: str) -> DataFrame:
    """A run history with one run per order, in five datasets."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("ds_"), (F.col("o_custkey") % 5).cast("string")).alias(
            "dataset_name"
        ),
        (
            F.col("o_orderdate")
            + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))
        ).alias("timestamp"),
        (F.col("o_totalprice") / 5000.0).alias("quality_score"),
        F.col("o_custkey").alias("rows"),
        F.lit(6).alias("columns"),
        F.lit(None).cast("string").alias("metrics_file"),
        F.lit("completed").alias("status"),
    )
