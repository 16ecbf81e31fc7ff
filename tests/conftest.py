from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # whole schemas in plans, for test_plans.py
        .config("spark.sql.maxMetadataStringLength", "100000")
        .config("spark.sql.debug.maxToStringFields", "1000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture
def people(spark):
    """Five people, one without a name."""
    return spark.createDataFrame(
        [
            (1, "Alice", 25, 50000),
            (2, "Bob", 30, 60000),
            (3, "Charlie", 35, 70000),
            (4, None, 40, 80000),
            (5, "Eve", 45, 90000),
        ],
        "id bigint, name string, age bigint, salary bigint",
    )


def by(df, key="column_name"):
    return {row[key]: row for row in df.collect()}
