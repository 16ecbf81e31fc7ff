"""Column naming, typing and null conventions.

Expressions over many columns are written as SQL text: building them call by call costs
a driver round trip per operation, which for a wide table outweighs running the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Reference a top-level column whose name may hold dots, blanks or backticks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """The same reference in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str | None) -> str:
    """A string literal in SQL text."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    # ${...} would be taken for a configuration variable
    return "'" + escaped.replace("${", "\\u0024{") + "'"


def number(value: float | None) -> str:
    """A double literal in SQL text."""
    if value is None or not math.isfinite(value):
        shown = "NULL" if value is None else f"'{value}'"
        return f"CAST({shown} AS DOUBLE)"
    return f"{float(value)!r}D"


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Every byte/short/int/long/float/double/decimal column; booleans are not numeric."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def ambiguous(df: DataFrame) -> list[str]:
    """Names that several columns share, as Spark resolves names, each once."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    keys = [c if exact else c.lower() for c in df.columns]
    return list(dict.fromkeys(c for c, k in zip(df.columns, keys) if keys.count(k) > 1))


def unambiguous(df: DataFrame) -> DataFrame:
    """``df`` without the columns that cannot be told apart by name."""
    lost = ambiguous(df)
    if not lost:
        return df
    kept = [(i, c) for i, c in enumerate(df.columns) if c not in lost]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(c) for i, c in kept])


def normalise(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in the float columns, so that both count as missing.

    Columns of equal names are left out; the suite reports them as errors.

    Spark sorts NaN above every number and lets it spread through avg and stddev;
    a missing measurement should do neither. Other columns pass through untouched,
    so pruning and pushdown on them keep working.
    """
    df = unambiguous(df)
    floats = (T.FloatType, T.DoubleType)
    if not any(isinstance(f.dataType, floats) for f in df.schema.fields):
        return df
    return df.selectExpr(
        *[
            f"nanvl({quoted(f.name)}, CAST(NULL AS {f.dataType.simpleString()})) "
            f"AS {quoted(f.name)}"
            if isinstance(f.dataType, floats)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def comparable(df: DataFrame) -> DataFrame:
    """Rewrite map columns as sorted entry arrays, so rows can be grouped and hashed."""
    if not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        return df
    return df.selectExpr(
        *[
            f"array_sort(map_entries({quoted(f.name)})) AS {quoted(f.name)}"
            if isinstance(f.dataType, T.MapType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(part: str, total: str) -> str:
    """SQL text for part / total as a double; 0 on an empty table."""
    return f"coalesce(CAST(try_divide({part}, {total}) AS DOUBLE), 0D)"


def fixed(value: Column, digits: int) -> Column:
    """Render with a fixed number of decimals, no grouping, ties to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))
