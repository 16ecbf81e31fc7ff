"""Quality per interval of event time, for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import (
    col,
    is_numeric,
    normalise,
    number,
    quoted,
    ratio,
    text,
)
from plumbline.functions.columns import comparable
from plumbline.operators.checks import Limits, distinct_key
from plumbline.plans.findings import FAILURE, SUCCESS


def quality_by_window(
    df: DataFrame,
    timestamp: str,
    window: str = "1 hour",
    columns: Iterable[str] | None = None,
    watermark: str | None = None,
    approx_distinct_error: float | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Completeness and consistency of each column in each window of ``timestamp``.

    The same aggregation serves a table and a stream. On a stream give a ``watermark``:
    state then holds open windows only, and rows later than it are dropped by Spark.
    Distinct values are reported when ``approx_distinct_error`` is given; windowed
    streams cannot count them exactly.

    All measures of a window are combined map-side, so a window holding most of the rows
    is one row per task in the shuffle.

    Rows without a time are in no window. On a table they are reported together, in rows
    whose bounds are NULL; on a stream, where no watermark would ever close such a row,
    ``rows_without_time`` counts them beside the windows.
    """
    stamp = col(timestamp)
    if isinstance(df.schema[timestamp].dataType, T.TimestampNTZType) and (
        df.isStreaming or watermark is not None
    ):
        # watermarks are defined on points in time only
        df = df.withColumn(timestamp, stamp.cast("timestamp"))
    names = [c for c in df.columns if c != timestamp] if columns is None else list(columns)
    numeric = {f.name for f in df.schema.fields if is_numeric(f.dataType)}
    rows = normalise(df.select(stamp, *[col(c) for c in names if c != timestamp]))
    if watermark is not None:
        rows = rows.withWatermark(timestamp, watermark)

    measures = ["count(*) AS n"]
    for i, name in enumerate(names):
        measures.append(f"count_if({quoted(name)} IS NULL) AS null{i}")
        if name in numeric:
            measures.append(f"count_if({quoted(name)} < 0) AS negative{i}")
            measures.append(
                f"count_if({quoted(name)} > {number(limits.outlier_above)}) AS huge{i}"
            )
        if approx_distinct_error is not None:
            measures.append(
                f"approx_count_distinct({quoted(name)}, {approx_distinct_error}) "
                f"AS distinct{i}"
            )
    if df.isStreaming or watermark is not None:
        keys = [F.window(stamp, window).alias("window")]
    else:
        # any moment does for rows without one: they are grouped apart
        moment = F.coalesce(stamp, F.lit(0).cast("timestamp").cast(df.schema[timestamp].dataType))
        keys = [F.window(moment, window).alias("window"), stamp.isNull().alias("untimed")]
    windows = rows.groupBy(*keys).agg(*[F.expr(measure) for measure in measures])
    if len(keys) == 2:
        windows = windows.withColumn("window", F.expr("if(untimed, NULL, window)"))

    entries = []
    for i, name in enumerate(names):
        share = ratio(f"n - null{i}", "n")
        fine = f"{share} >= {number(limits.completeness_min)}"
        negative = huge = "CAST(NULL AS BIGINT)"
        if name in numeric:
            negative, huge = f"negative{i}", f"huge{i}"
            fine = f"{fine} AND {negative} = 0 AND {huge} = 0"
        entry = (
            f"'column_name', {text(name)}, 'total_count', n, 'null_count', null{i}, "
            f"'completeness_ratio', {share}, 'negative_count', {negative}, "
            f"'outlier_count', {huge}, "
            f"'status', if({fine}, {text(SUCCESS)}, {text(FAILURE)})"
        )
        if approx_distinct_error is not None:
            entry += f", 'approx_distinct', distinct{i}"
        entries.append(f"named_struct({entry})")
    return windows.selectExpr(
        "window.start AS window_start",
        "window.end AS window_end",
        f"inline(array({', '.join(entries)}))",
    )


def rows_without_time(df: DataFrame, timestamp: str) -> DataFrame:
    """One row: how many rows have no event time, and how many there are.

    On a stream write it in ``complete`` mode; its state is one row.
    """
    return df.agg(
        F.count_if(col(timestamp).isNull()).alias("untimed_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def _value_text(data_type: T.DataType, value: str) -> str:
    """A string that is equal for equal values of a column only."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = f"if({value} = 0, abs({value}), {value})"  # zeros of one sign
    elif isinstance(data_type, T.TimestampType):
        value = f"unix_micros({value})"  # local times may name two moments
    return f"CAST({distinct_key(data_type, value)} AS STRING)"


def distinct_by_window(
    df: DataFrame,
    timestamp: str,
    window: str = "1 hour",
    columns: Iterable[str] | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Exact counts of filled and of distinct values of each column in each window.

    Works on a table and on a stream, in ``append`` mode. On a stream two groupings follow one
    another: the first keeps a count per window, column and value, and hands it on when the
    watermark closes the window; the second adds these up. State is therefore one short row per
    distinct value of the open windows, dealt by value, so a window or value that holds most of
    the rows fills no task; it is dropped when the window closes. Values wider than 64 bytes are
    counted by digest. Missing values (NULL, NaN) are not distinct values; a window without
    filled values of a column has a row with zeros. Rows without event time are in no window.
    """
    stamp = col(timestamp)
    if isinstance(df.schema[timestamp].dataType, T.TimestampNTZType):
        df = df.withColumn(timestamp, stamp.cast("timestamp"))
    names = [c for c in df.columns if c != timestamp] if columns is None else list(columns)
    df = comparable(normalise(df.select(stamp, *[col(c) for c in names if c != timestamp])))
    rows = df.selectExpr(
        quoted(timestamp),
        *[f"{_value_text(df.schema[n].dataType, quoted(n))} AS __value{i}" for i, n in enumerate(names)],
    )
    if watermark is not None:
        rows = rows.withWatermark(timestamp, watermark)
    entries = ", ".join(
        f"named_struct('column_name', {text(n)}, 'value', __value{i})" for i, n in enumerate(names)
    )
    values = (
        rows.filter(stamp.isNotNull())
        .select(stamp, F.expr(f"inline(array({entries}))"))
        .groupBy(F.window(stamp, window).alias("window"), "column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    again = F.window(F.window_time("window"), window).alias("window")
    return (
        values.groupBy(again, "column_name")
        .agg(
            F.sum("n").alias("total_count"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled_count"),
            F.count("value").alias("distinct_count"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "column_name", "total_count", "filled_count", "distinct_count",
        )
    )
