"""Missing values and the issue summary of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import (
    normalise,
    numeric_columns,
    ratio,
    text,
    text_columns,
)
from plumbline.operators.checks import nulls, total
from plumbline.operators.duplicates import duplicate_rows
from plumbline.plans import Finding, Measures, findings_frame


def missing_by_column(df: DataFrame) -> DataFrame:
    """column_name, missing_count, missing_percentage of the columns that lack values."""
    df, m = normalise(df), Measures()
    found = [
        Finding(
            "missing",
            name,
            name,
            metrics={"count": nulls(m, name), "total": total(m)},
        )
        for name in df.columns
    ]
    share = ratio("metrics['count']", "metrics['total']")
    return (
        findings_frame(df, m, found)
        .selectExpr(
            "column_name",
            "CAST(metrics['count'] AS BIGINT) AS missing_count",
            f"{share} * 100 AS missing_percentage",
        )
        .filter(F.col("missing_count") > 0)
    )


def total_missing(df: DataFrame) -> DataFrame:
    """One row: missing cells over all columns."""
    df, m = normalise(df), Measures()
    counts = [nulls(m, name) for name in df.columns]
    return m.frame(df).selectExpr(
        f"CAST({' + '.join(counts) or 0} AS BIGINT) AS missing_cells"
    )


def issue_summary(df: DataFrame) -> DataFrame:
    """One row: size, missing values, duplicate rows, types and column classes."""
    frame, m = normalise(df), Measures()
    n = total(m)
    entries = []
    for name in frame.columns:
        missing = nulls(m, name)
        entries.append(
            f"named_struct('column_name', {text(name)}, "
            f"'missing_count', CAST({missing} AS BIGINT), "
            f"'missing_percentage', {ratio(missing, n)} * 100)"
        )
    facts = m.frame(frame).selectExpr(
        f"CAST({n} AS BIGINT) AS total_rows",
        f"filter(array({', '.join(entries)}), e -> e.missing_count > 0) "
        "AS missing_values",
    )
    types = [
        f"named_struct('column_name', {text(f.name)}, "
        f"'data_type', {text(f.dataType.simpleString())})"
        for f in frame.schema.fields
    ]
    # Two one-row results side by side: stacked, then folded into one row.
    stacked = facts.unionByName(duplicate_rows(df), allowMissingColumns=True)
    return stacked.selectExpr(
        "max(total_rows) AS total_rows",
        "max(missing_values) AS missing_values",
        "max(duplicate_rows) AS duplicate_rows",
    ).selectExpr(
        "total_rows",
        f"{len(df.columns)} AS total_columns",
        "missing_values",
        "duplicate_rows",
        f"array({', '.join(types)}) AS data_types",
        f"{_names(numeric_columns(df))} AS numeric_columns",
        f"{_names(text_columns(df))} AS categorical_columns",
    )


def _names(names: list[str]) -> str:
    return f"CAST(array({', '.join(map(text, names))}) AS ARRAY<STRING>)"
