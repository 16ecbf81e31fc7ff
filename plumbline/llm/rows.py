"""Reading the columns an operator needs, whatever else a table holds."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.pinning import pin

#: One white-space character, as the operators understand it.
SPACE = r"[\x20\x09-\x0D]"


def positions(names: list[str], wanted: str) -> int:
    """Index of the column called exactly ``wanted``, else the same without case."""
    if wanted in names:
        return names.index(wanted)
    lowered = [n.lower() for n in names]
    if wanted.lower() in lowered:
        return lowered.index(wanted.lower())
    raise ValueError(f"no column {wanted} in {names}")


def _reach(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver has it.

    They look along their PYTHONPATH; a package installed on the executors is found
    anyway, and a folder that an executor does not have changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under internal names: ``pick(df, key="doc_id")``.

    Columns are found by position, so extra columns may have any names, also names
    that differ in case only or that an operator uses itself.
    """
    _reach(df.sparkSession)
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(
        [F.col(f"_{positions(df.columns, name)}").alias(alias) for alias, name in wanted.items()]
    )


def identified(df: DataFrame) -> DataFrame:
    """``df`` with two columns ``__file`` and ``__row`` that tell its rows apart.

    Rows read from Parquet files are known by file and position, which any later scan
    of the same files finds again. Other rows are numbered and pinned, so a lost
    executor cannot renumber them. A table that has both columns is returned as it is.
    """
    if df.columns[-2:] == ["__file", "__row"]:
        return df
    try:
        return df.select(
            "*",
            F.xxhash64("_metadata.file_path").alias("__file"),
            F.col("_metadata.row_index").alias("__row"),
        )
    except AnalysisException:
        numbered = df.select(
            "*",
            F.lit(0).cast("bigint").alias("__file"),
            F.monotonically_increasing_id().alias("__row"),
        )
        return pin(numbered)


def word_count(text: Column) -> Column:
    """Number of words between white space; NULL counts as no text."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    first = (F.element_at(pieces, 1) == "").cast("bigint")
    last = ((F.element_at(pieces, -1) == "") & (F.size(pieces) > 1)).cast("bigint")
    return F.size(pieces).cast("bigint") - first - last


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(known: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of an ``identified`` table that are not in ``lost``, without identity."""
    names = known.columns[:-2]
    flat = known.toDF(*[f"_{i}" for i in range(len(names))], "__file", "__row")
    left = flat.join(lost.select("__file", "__row"), ["__file", "__row"], "left_anti")
    return left.drop("__file", "__row").toDF(*names)
