"""All checks of a table at once, and what is read off their results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, normalise, ratio
from plumbline.functions.columns import ambiguous
from plumbline.operators.checks import (
    Limits,
    MailColumns,
    Patterns,
    Ranges,
    completeness_findings,
    consistency_findings,
    mail_findings,
    pattern_findings,
    range_findings,
    text_findings,
    total,
    uniqueness_findings,
)
from plumbline.operators.profile import profile_findings, suggestion_findings
from plumbline.plans import Finding, Measures, findings_frame
from plumbline.plans.findings import ERROR, FAILURE, SUCCESS
from plumbline.plans.measures import DISTINCT_BATCH


SCORE = f"{ratio('passed_checks', 'total_checks')} * 100"


def run_suite(
    df: DataFrame,
    ranges: Ranges | None = None,
    patterns: Patterns | None = None,
    limits: Limits = Limits(),
    mail: MailColumns = MailColumns(),
    text: bool = True,
    profile: bool = True,
    approx_distinct_error: float | None = None,
    distinct_batch: int = DISTINCT_BATCH,
) -> DataFrame:
    """Check results of every check that applies, in long form.

    Completeness, uniqueness and consistency always; text when there are string columns;
    mail checks when a mail column exists; range and pattern checks as specified. Profile
    and suggestion rows carry no status. All of it shares one fused aggregate plus one
    small batch of columns at a time for the exact distinct counts.
    """
    lost, width = ambiguous(df), len(df.columns)
    df, m = normalise(df), Measures(approx_distinct_error)
    found: list[Finding] = [
        Finding(check, name, f"{check.title()} of {name}", error=f"column name {name} is ambiguous")
        for name in lost
        for check in ("completeness", "uniqueness")
    ]
    found += completeness_findings(df, m, None, limits)
    found += uniqueness_findings(df, m, None, limits)
    found += consistency_findings(df, m, None, limits)
    if text:
        found += text_findings(df, m, None, limits)
    if mail.present_in(df):
        found += mail_findings(df, m, mail, limits)
    if ranges:
        found += range_findings(df, m, ranges, limits)
    if patterns:
        found += pattern_findings(df, m, patterns, limits)
    found.append(
        Finding(
            "dataset_info",
            None,
            "Dataset info",
            metrics={"rows": total(m), "columns": str(width)},
        )
    )
    if profile:
        found += profile_findings(df, m)
        found += suggestion_findings(df, m)
    return findings_frame(df, m, found, distinct_batch)


def quality_score(results: DataFrame) -> DataFrame:
    """total_checks, passed_checks, quality_score (percent); errors do not count."""
    counted = F.col("status").isin(SUCCESS, FAILURE)
    return results.agg(
        F.count_if(counted).alias("total_checks"),
        F.count_if(F.col("status") == SUCCESS).alias("passed_checks"),
    ).selectExpr("*", f"{SCORE} AS quality_score")


def check_type_summary(results: DataFrame) -> DataFrame:
    """Per check type: how many checks ran, passed and failed, and the success rate."""
    return (
        results.filter(F.col("status").isin(SUCCESS, FAILURE))
        .groupBy("check_type")
        .agg(
            F.count(F.lit(1)).alias("total_checks"),
            F.count_if(F.col("status") == SUCCESS).alias("passed"),
            F.count_if(F.col("status") == FAILURE).alias("failed"),
        )
        .select(
            F.initcap(F.replace(F.col("check_type"), F.lit("_"), F.lit(" "))).alias(
                "check_type"
            ),
            "total_checks",
            "passed",
            "failed",
            F.concat(
                fixed(F.col("passed") / F.col("total_checks") * 100, 1), F.lit("%")
            ).alias("success_rate"),
        )
    )


def suite_metrics(results: DataFrame) -> DataFrame:
    """Results unfolded to one row per metric."""
    return results.select(
        "check_type",
        "column_name",
        "constraint",
        "status",
        F.explode("metrics").alias("metric", "value"),
    )


def dataset_info(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")
    )


def run_record(
    results: DataFrame,
    dataset_name: str,
    run_id: str,
    timestamp: datetime.datetime | Column,
    metrics_file: str | None = None,
) -> DataFrame:
    """The run's history row, read off its results."""
    info = F.col("check_type") == "dataset_info"
    return results.agg(
        F.count_if(F.col("status").isin(SUCCESS, FAILURE)).alias("total_checks"),
        F.count_if(F.col("status") == SUCCESS).alias("passed_checks"),
        F.max(F.when(info, F.col("metrics")["rows"])).alias("rows"),
        F.max(F.when(info, F.col("metrics")["columns"])).alias("columns"),
    ).select(
        F.lit(run_id).alias("run_id"),
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(timestamp).cast("timestamp").alias("timestamp"),
        F.expr(f"{SCORE} AS quality_score"),
        F.col("rows").cast("bigint").alias("rows"),
        F.col("columns").cast("int").alias("columns"),
        F.lit(metrics_file).cast("string").alias("metrics_file"),
        F.lit("completed").alias("status"),
    )


def failed_to_run(results: DataFrame) -> DataFrame:
    """Checks that could not be evaluated, with the reason."""
    return results.filter(F.col("status") == ERROR).select(
        "check_type",
        "column_name",
        "constraint",
        F.col("params")["error"].alias("error"),
    )
