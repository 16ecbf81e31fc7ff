"""Z-band anomalies: values further than ``threshold`` deviations from the mean.

Finding them takes two passes by nature. The first reads one row of means and sample
deviations; the second compares against constants, which lets a columnar source skip row
groups whose minimum and maximum lie inside the band.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import (
    col,
    is_numeric,
    normalise,
    number,
    numeric_columns,
    outside,
    quoted,
    text,
)
from plumbline.operators.profile import bin_edges, binned
from plumbline.plans import Finding, Measures, findings_frame


@dataclass(frozen=True)
class Band:
    mean: float | None
    std: float | None
    threshold: float = 2.0

    @property
    def known(self) -> bool:
        """Without a finite mean and deviation there is no band and no anomaly.

        That is so for a column with fewer than two values or with an infinite one.
        """
        return all(x is not None and math.isfinite(x) for x in (self.mean, self.std))

    @property
    def lower(self) -> float | None:
        return self.mean - self.threshold * self.std if self.known else None

    @property
    def upper(self) -> float | None:
        return self.mean + self.threshold * self.std if self.known else None

    def excludes(self, value: str) -> str:
        """SQL text for: the value lies outside the band."""
        return outside(value, self.lower, self.upper) if self.known else "false"


def _double(name: str) -> str:
    return f"CAST({quoted(name)} AS DOUBLE)"


def _hit(name: str, band: Band) -> str:
    """The value where it is an anomaly, else NULL."""
    return f"if({band.excludes(_double(name))}, {_double(name)}, CAST(NULL AS DOUBLE))"


def _columns(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    if columns is None:
        return numeric_columns(df)
    names = [c for c in columns if c in df.columns]
    for name in names:
        if not is_numeric(df.schema[name].dataType):
            raise ValueError(f"column {name} is not numeric")
    return names


def fit_bands(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = 2.0
) -> dict[str, Band]:
    """The band of each numeric column; one scan, one row to the driver."""
    names = _columns(df, columns)
    if not names:
        return {}
    aggregates = []
    for i, name in enumerate(names):
        aggregates.append(f"avg({_double(name)}) AS mean{i}")
        aggregates.append(f"stddev_samp({_double(name)}) AS std{i}")
    row = normalise(df).selectExpr(*aggregates).first()
    return {
        name: Band(row[f"mean{i}"], row[f"std{i}"], threshold)
        for i, name in enumerate(names)
    }


def anomaly_counts(df: DataFrame, bands: Mapping[str, Band]) -> DataFrame:
    """Per column: the band, the values outside it and their share of all rows (in %)."""
    df, m, found = normalise(df), Measures(), []
    for name, band in bands.items():
        n = m.rows()
        hits = m.count_if(name, band.excludes(_double(name)))
        found.append(
            Finding(
                "anomaly",
                name,
                name,
                metrics={
                    "mean": number(band.mean),
                    "std": number(band.std),
                    "lower_bound": number(band.lower),
                    "upper_bound": number(band.upper),
                    "anomaly_count": hits,
                    "anomaly_percentage": f"try_divide({hits}, {n}) * 100",
                    "total_count": n,
                },
            )
        )
    return findings_frame(df, m, found).selectExpr(
        "column_name",
        *[f"metrics['{k}'] AS {k}" for k in ("mean", "std", "lower_bound", "upper_bound")],
        "CAST(metrics['anomaly_count'] AS BIGINT) AS anomaly_count",
        "metrics['anomaly_percentage'] AS anomaly_percentage",
        "CAST(metrics['total_count'] AS BIGINT) AS total_count",
    )


def detect_anomalies(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = 2.0
) -> DataFrame:
    return anomaly_counts(df, fit_bands(df, columns, threshold))


def _with_hits(df: DataFrame, bands: Mapping[str, Band]) -> DataFrame:
    """Rows with an anomaly in any column, by a filter the source can evaluate.

    NaN passes this filter (Spark sorts it last) and is dropped by what follows.
    """
    tests = [band.excludes(quoted(name)) for name, band in bands.items()]
    return normalise(df.filter(" OR ".join(tests) or "false"))


def anomaly_rows(
    df: DataFrame, bands: Mapping[str, Band], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per anomalous value: column_name, the caller's key columns, value.

    Rows without any anomaly are dropped first, by a filter on the source columns, so
    only the few that have one are unfolded into a row per column.
    """
    if not bands:
        raise ValueError("no numeric columns to look at")
    entries = ", ".join(
        f"named_struct('column_name', {text(name)}, 'value', {_hit(name, band)}, "
        f"'lower_bound', {number(band.lower)}, 'upper_bound', {number(band.upper)})"
        for name, band in bands.items()
    )
    hits = _with_hits(df, bands).selectExpr(
        *[quoted(k) for k in keys], f"inline(array({entries}))"
    )
    return hits.filter(F.col("value").isNotNull()).select(
        "column_name", *[col(k) for k in keys], "value", "lower_bound", "upper_bound"
    )


def anomaly_headline(counts: DataFrame) -> DataFrame:
    """Total anomalies, mean percentage, analysed columns and columns with a hit."""
    return counts.agg(
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("total_anomalies"),
        F.avg("anomaly_percentage").alias("average_percentage"),
        F.count(F.lit(1)).alias("columns_analysed"),
        F.count_if(F.col("anomaly_count") > 0).alias("columns_with_anomalies"),
    )


def anomaly_histogram(
    df: DataFrame, bands: Mapping[str, Band], bins: int = 20
) -> DataFrame:
    """Equal-width bins of the anomalous values of each column, with its band.

    Infinite values are in no bin.
    """
    infinity = number(math.inf)
    numbers = _with_hits(df, bands).selectExpr(
        *[
            f"if(abs({_hit(name, band)}) < {infinity}, {_hit(name, band)}, NULL) "
            f"AS {quoted(name)}"
            for name, band in bands.items()
        ]
    )
    context = ", ".join(
        f"{text(name)}, named_struct('mean', {number(band.mean)}, "
        f"'lower_bound', {number(band.lower)}, 'upper_bound', {number(band.upper)})"
        for name, band in bands.items()
    )
    return (
        binned(numbers, bin_edges(numbers, bands, bins))
        .withColumn("band", F.expr(f"map({context})[column_name]"))
        .select("column_name", "bin", "lower_edge", "upper_edge", "value_count", "band.*")
    )
