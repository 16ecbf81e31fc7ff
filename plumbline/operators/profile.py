"""Column profiles, describe, type roll-ups, histograms and top values."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import (
    col,
    is_numeric,
    is_text,
    normalise,
    number,
    numeric_columns,
    quoted,
)
from plumbline.operators.checks import countable, distinct, nulls, total
from plumbline.operators.quantiles import moments_and_quantiles
from plumbline.plans import Finding, Measures, findings_frame
from plumbline.plans.measures import DISTINCT_BATCH
from plumbline.sources.pinning import pin

#: Characters by which values are counted; longer ones also by a digest.
PREFIX = 64
#: Winners that may be broadcast; ties beyond them are joined by shuffle.
MAX_WINNERS = 100_000


def _double(name: str) -> str:
    return f"CAST({quoted(name)} AS DOUBLE)"


def profile_findings(df: DataFrame, m: Measures) -> list[Finding]:
    """Type, row, null and distinct counts; min, max, mean and sample std of numbers."""
    out = []
    for field in df.schema.fields:
        name = field.name
        metrics = {
            "total_count": total(m),
            "null_count": nulls(m, name),
        }
        if countable(field.dataType):
            metrics["distinct_count"] = distinct(m, df, name)
        if is_numeric(field.dataType):
            x = _double(name)
            metrics["min"] = m.stat(name, f"min({x})")
            metrics["max"] = m.stat(name, f"max({x})")
            metrics["mean"] = m.stat(name, f"avg({x})")
            metrics["std"] = m.stat(name, f"stddev_samp({x})")
        out.append(
            Finding(
                "data_profile",
                name,
                f"Profile of {name}",
                metrics=metrics,
                params={"data_type": field.dataType.simpleString()},
            )
        )
    return out


def suggestion_findings(df: DataFrame, m: Measures) -> list[Finding]:
    """Which check suits each column, with the observed bounds of a numeric one."""
    out = []
    for field in df.schema.fields:
        name = field.name
        if is_numeric(field.dataType):
            x = _double(name)
            out.append(
                Finding(
                    "constraint_suggestions",
                    name,
                    f"Column {name} is numeric - consider range checks",
                    metrics={
                        "min": m.stat(name, f"min({x})"),
                        "max": m.stat(name, f"max({x})"),
                    },
                )
            )
        elif is_text(field.dataType):
            out.append(
                Finding(
                    "constraint_suggestions",
                    name,
                    f"Column {name} is string - consider pattern checks",
                )
            )
    return out


def column_profile(
    df: DataFrame,
    approx_distinct_error: float | None = None,
    distinct_batch: int = DISTINCT_BATCH,
) -> DataFrame:
    """One row per column."""
    df, m = normalise(df), Measures(approx_distinct_error)
    return findings_frame(df, m, profile_findings(df, m), distinct_batch).selectExpr(
        "column_name",
        "params['data_type'] AS data_type",
        *[
            f"CAST(metrics['{name}'] AS BIGINT) AS {name}"
            for name in ("total_count", "null_count", "distinct_count")
        ],
        *[f"metrics['{name}'] AS {name}" for name in ("min", "max", "mean", "std")],
    )


def column_card(df: DataFrame, approx_distinct_error: float | None = None) -> DataFrame:
    """Type, distinct values, missing values and, for numbers, min, max and mean."""
    return column_profile(df, approx_distinct_error).select(
        "column_name",
        "data_type",
        F.col("distinct_count").alias("unique_values"),
        F.col("null_count").alias("missing_values"),
        "min",
        "max",
        "mean",
    )


def suggest_constraints(df: DataFrame) -> DataFrame:
    df, m = normalise(df), Measures()
    return findings_frame(df, m, suggestion_findings(df, m)).selectExpr(
        "column_name",
        "constraint AS suggestion",
        "metrics['min'] AS observed_min",
        "metrics['max'] AS observed_max",
    )


def data_types(df: DataFrame) -> DataFrame:
    """Column names and types, from the schema alone."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column_name string, data_type string",
    )


def dtype_distribution(df: DataFrame) -> DataFrame:
    """Columns per type, and how many of their cells are filled."""
    df, m = normalise(df), Measures()
    found = [
        Finding(
            "types",
            f.name,
            f.name,
            metrics={"filled": f"{total(m)} - {nulls(m, f.name)}"},
            params={"data_type": f.dataType.simpleString()},
        )
        for f in df.schema.fields
    ]
    return (
        findings_frame(df, m, found)
        .groupBy(F.col("params")["data_type"].alias("data_type"))
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            F.sum(F.col("metrics")["filled"].cast("bigint")).alias("filled_cells"),
        )
    )


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles (linear interpolation) and max per column."""
    df = normalise(df)
    names = list(numeric_columns(df) if columns is None else columns)
    known, quantiles = moments_and_quantiles(df, names, (0.25, 0.5, 0.75))
    moments = df.sparkSession.createDataFrame(
        [(n, m.count, m.mean, m.std, m.min, m.max) for n, m in known.items()],
        "column_name string, count bigint, mean double, std double, min double, max double",
    )
    quartiles = quantiles.groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(alias)
            for p, alias in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        ]
    )
    # one row per column on either side
    return moments.join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def histogram(
    df: DataFrame, columns: Iterable[str] | None = None, bins: int = 20
) -> DataFrame:
    """Equal-width bins between the smallest and largest finite value of each column.

    The last bin is closed on the right. Empty bins are listed with count 0; a column
    with one distinct value gets a single bin. NULL and infinite values are in no bin.

    The bounds are read first (one row), so the second scan bins with constants, counts
    map-side and shuffles at most ``bins`` rows per column and task.
    """
    df = normalise(df)
    names = list(numeric_columns(df) if columns is None else columns)
    infinity = number(math.inf)
    numbers = df.selectExpr(
        *[
            f"if(abs({_double(n)}) < {infinity}, {_double(n)}, NULL) AS {quoted(n)}"
            for n in names
        ]
    )
    return binned(numbers, bin_edges(numbers, names, bins))


def bin_edges(
    df: DataFrame, names: Iterable[str], bins: int
) -> dict[str, tuple[float, float, int]]:
    """(smallest, largest, bins) of each column that holds a value; one row is read."""
    names = list(names)
    if not names:
        return {}
    bounds = df.selectExpr(
        *[f"min({quoted(n)}) AS lo{i}" for i, n in enumerate(names)],
        *[f"max({quoted(n)}) AS hi{i}" for i, n in enumerate(names)],
    ).first()
    return {
        n: (bounds[f"lo{i}"], bounds[f"hi{i}"], bins)
        for i, n in enumerate(names)
        if bounds[f"lo{i}"] is not None
    }


def binned(df: DataFrame, edges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Count the values of each column of ``edges`` into its equal-width bins."""
    schema = (
        "column_name string, bin int, lower_edge double, upper_edge double, "
        "value_count bigint"
    )
    if not edges:
        return df.sparkSession.createDataFrame([], schema)
    frame = []
    indexes = []
    for name, (low, high, bins) in edges.items():
        bins = bins if high > low else 1
        width = (high - low) / bins
        last = bins - 1
        # least() skips NULLs, so missing values have to be kept out of the last bin
        index = (
            f"least(floor(({quoted(name)} - {number(low)}) / {number(width)}), {last})"
            if width > 0
            else "0"
        )
        indexes.append(
            f"if({quoted(name)} IS NULL, NULL, CAST({index} AS INT)) AS {quoted(name)}"
        )
        frame.extend(
            (name, b, low + b * width, high if b == last else low + (b + 1) * width, 0)
            for b in range(bins)
        )
    counts = (
        df.selectExpr(*indexes)
        .unpivot([], [col(n) for n in edges], "column_name", "bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column_name", "bin")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )
    empty = df.sparkSession.createDataFrame(frame, schema)
    none = F.lit(None).cast("double")
    return (
        empty.unionByName(
            counts.withColumns({"lower_edge": none, "upper_edge": none})
        )
        .groupBy("column_name", "bin")
        .agg(
            F.max("lower_edge").alias("lower_edge"),
            F.max("upper_edge").alias("upper_edge"),
            F.sum("value_count").alias("value_count"),
        )
    )


def top_values(
    df: DataFrame, columns: Iterable[str] | None = None, k: int = 10
) -> DataFrame:
    """The ``k`` most frequent non-null values of each (by default non-numeric) column.

    Ties go to the smaller value. Values are counted map-side before the shuffle by at
    most their first ``PREFIX`` characters and a digest, and each task hands on only its
    own best ``k`` per column to the ranking, and one more. Only if a winner is longer than
    that, a second scan looks up the whole values of the winners, few as they are. If longer
    values of one start and one count go on beyond the ``k``-th place, those are compared by
    their whole values, of which each task again hands on ``k``.
    """
    df = normalise(df)
    names = (
        [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
        if columns is None
        else list(columns)
    )
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, value string, value_count bigint, rank int"
        )
    marked = marked_values(df, names)
    ranked = pin(frequent_keys(marked, k + 1))
    chosen, tied = split_at_limit(ranked, k)
    short_ones = chosen.filter(F.col("digest") == "").withColumn("value", F.col("short"))
    kept = ["column_name", "value", "value_count"]
    if chosen.filter(F.col("digest") != "").isEmpty():
        found = short_ones.select(*kept)
    else:
        winners = chosen.filter(F.col("digest") != "").select("column_name", "digest", "value_count")
        if winners.count() <= MAX_WINNERS:
            winners = F.broadcast(winners)
        long_ones = (
            marked.filter(F.col("digest") != "")
            .join(winners, ["column_name", "digest"])
            .groupBy("column_name", "digest")
            .agg(F.max("value").alias("value"), F.max("value_count").alias("value_count"))
        )
        found = short_ones.select(*kept).unionByName(long_ones.select(*kept))
    if tied:
        found = found.unionByName(smallest_of_ties(marked, tied, k).select(*kept))
    order = Window.partitionBy("column_name").orderBy(F.desc("value_count"), "value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def marked_values(df: DataFrame, names: list[str]) -> DataFrame:
    """column_name, value, its first characters and, if it is longer, its digest."""
    values = (
        df.selectExpr(*[f"CAST({quoted(n)} AS STRING) AS {quoted(n)}" for n in names])
        .unpivot([], [col(n) for n in names], "column_name", "value")
        .filter(F.col("value").isNotNull())
    )
    short = F.substring("value", 1, PREFIX)
    digest = F.when(F.char_length("value") > PREFIX, F.sha2("value", 256))
    return values.withColumns({"short": short, "digest": F.coalesce(digest, F.lit(""))})


def counted_keys(marked: DataFrame) -> DataFrame:
    return marked.groupBy("column_name", "short", "digest").agg(
        F.count(F.lit(1)).alias("value_count")
    )


def frequent_keys(marked: DataFrame, k: int) -> DataFrame:
    """What ``k`` most frequent values of each column are counted by: ``k`` rows at most.

    Values of equal counts and starts are put in order by their digest here.
    """
    best = Window.partitionBy("column_name").orderBy(F.desc("value_count"), "short", "digest")
    return counted_keys(marked).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def split_at_limit(ranked: DataFrame, k: int) -> tuple[DataFrame, list]:
    """Rows that belong to the best ``k``, and per column the (start, count) that may not.

    Where the rows ``k`` and ``k + 1`` are longer values of one start and one count, which
    of all such values come first is open: they are left to ``smallest_of_ties``.
    """
    edge = (
        ranked.filter(F.col("rank").isin(k, k + 1) & (F.col("digest") != ""))
        .groupBy("column_name", "short", "value_count")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 2")
        .select("column_name", "short", "value_count")
    )
    tied = edge.collect()  # one row per column at most
    best = ranked.filter(F.col("rank") <= k)
    for row in tied:
        own = (F.col("column_name") == row.column_name) & (F.col("short") == row.short)
        best = best.filter(~(own & (F.col("value_count") == row.value_count)))
    return best, tied


def smallest_of_ties(marked: DataFrame, tied: list, k: int) -> DataFrame:
    """The ``k`` smallest whole values per column among those of a start and a count."""
    wanted = marked.sparkSession.createDataFrame(
        [tuple(row) for row in tied], "column_name string, short string, value_count bigint"
    )
    alike = marked.filter(F.col("digest") != "").join(
        F.broadcast(wanted), ["column_name", "short"]
    )
    key = ["column_name", "digest"]
    ties = alike.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max("value_count").alias("value_count")
    ).filter("n = value_count").select(*key)
    values = alike.join(ties, key, "left_semi").groupBy(*key).agg(
        F.min("value").alias("value"), F.max("value_count").alias("value_count")
    )
    order = Window.partitionBy("column_name").orderBy("value")
    return values.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
