"""Rows that repeat an earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import normalise, quoted
from plumbline.functions.columns import comparable


def _shape(kind: T.DataType, value: str, depth: int = 0) -> str | None:
    """SQL text of where a nested value holds NULLs and how long it is.

    The hash passes over NULLs and empty arrays, so their places go in as well.
    """
    if isinstance(kind, T.ArrayType):
        x = f"x{depth}"
        inner = _shape(kind.elementType, x, depth + 1)
        parts = ", ".join(filter(None, [f"{x} IS NULL", inner]))
        return f"struct(size({value}), transform({value}, {x} -> struct({parts})))"
    if isinstance(kind, T.StructType):
        parts = []
        for field in kind.fields:
            part = f"{value}.{quoted(field.name)}"
            parts += filter(None, [f"{part} IS NULL", _shape(field.dataType, part, depth)])
        return f"struct({', '.join(parts)})" if parts else None
    return None


def _prints(rows: DataFrame) -> Column:
    """128 bits of a row: two hashes of all columns and of where they hold NULLs."""
    parts = []
    for field in rows.schema.fields:
        name = quoted(field.name)
        parts += filter(None, [name, f"{name} IS NULL", _shape(field.dataType, name)])
    both = ", ".join(parts)
    return F.expr(f"struct(xxhash64({both}) AS a, xxhash64('other', {both}) AS b)")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with ``copies``. NULLs equal each other.

    A first pass shuffles a fingerprint and a count per row, combined map-side, to find
    the fingerprints that occur more than once. Only rows that carry one of them are
    grouped by all columns, which rules out collisions. How those rows are picked is
    left to Spark: it broadcasts the fingerprints if they turn out to be few.
    """
    rows = comparable(normalise(df))
    names = [quoted(c) for c in rows.columns]
    repeated = (
        rows.groupBy(_prints(rows).alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select(F.col("fingerprint.a").alias("__a"), F.col("fingerprint.b").alias("__b"))
    )
    marked = rows.withColumn("__print", _prints(rows))
    same = (F.col("__print.a") == F.col("__a")) & (F.col("__print.b") == F.col("__b"))
    return (
        marked.join(repeated, same, "left_semi")
        .drop("__print")
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier one (``rows - distinct rows``).

    One scan, whatever the share of duplicates: rows are counted by their 128-bit
    fingerprint, combined map-side, and only that is shuffled.
    """
    rows = comparable(normalise(df))
    counts = rows.groupBy(_prints(rows).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return counts.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows")
    )
