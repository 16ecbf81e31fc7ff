"""Completeness, uniqueness, consistency, range, pattern, text and mail checks.

A ``*_findings`` function registers what it needs with a :class:`Measures` and returns
the result rows; the suite gathers those of all checks before anything runs. The public
functions run one check alone and return flat, typed columns.
"""

from __future__ import annotations

import datetime
import decimal
import numbers
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import (
    bad_email,
    col,
    is_numeric,
    is_text,
    longer_than,
    looks_like_spam,
    normalise,
    number,
    numeric_columns,
    outside,
    quoted,
    ratio,
    shorter_than,
    text,
    text_columns,
)
from plumbline.plans import Finding, Measures, findings_frame
from plumbline.plans.measures import DISTINCT_BATCH


@dataclass(frozen=True)
class Limits:
    """What each check accepts. Shares are fractions of all rows."""

    completeness_min: float = 0.95
    uniqueness_min: float = 0.9
    outlier_above: float = 1e10
    short_chars: int = 10
    long_chars: int = 1000
    null_text_max: float = 0.1
    empty_text_max: float = 0.05
    short_text_max: float = 0.3
    long_text_max: float = 0.1
    bad_email_max: float = 0.05
    spam_max: float = 0.1
    bad_sentiment_max: float = 0.05
    sentiment_low: float = -1.0
    sentiment_high: float = 1.0


@dataclass(frozen=True)
class MailColumns:
    """Names of the columns the mail checks look at."""

    sender: str = "sender_email"
    subject: str = "subject"
    sentiment: str = "sentiment_score"
    content: str = "email_content"

    def present_in(self, df: DataFrame) -> bool:
        return any(c in df.columns for c in (self.sender, self.subject, self.content))


Ranges = Mapping[str, Mapping[str, Any]]
Patterns = Mapping[str, str]


# ---------------------------------------------------------------- shared measures


def total(m: Measures) -> str:
    return m.rows()


def nulls(m: Measures, name: str) -> str:
    return m.count_if(name, f"{quoted(name)} IS NULL")


def distinct(m: Measures, df: DataFrame, name: str) -> str:
    return m.distinct(name, distinct_key(df.schema[name].dataType, quoted(name)))


def countable(data_type: T.DataType) -> bool:
    """Whether distinct values of a type can be counted; maps only as whole columns."""
    if isinstance(data_type, T.MapType):
        return _groupable(data_type.keyType) and _groupable(data_type.valueType)
    return _groupable(data_type)


def _groupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _groupable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_groupable(f.dataType) for f in data_type.fields)
    return not isinstance(
        data_type, (T.MapType, T.VariantType, T.CalendarIntervalType)
    )


def distinct_key(data_type: T.DataType, value: str) -> str:
    """What to group by to count a column's distinct values.

    Long strings are grouped by their SHA-256, so that counting distinct documents
    shuffles 65 bytes a piece and not the documents. Short ones stay as they are; being
    shorter than a marked digest they cannot be mistaken for one. Binary values, arrays
    and structs are digested likewise.
    """
    if isinstance(data_type, T.MapType):
        return f"array_sort(map_entries({value}))"
    if data_type == T.StringType():
        return f"if(octet_length({value}) > 64, concat('#', sha2({value}, 256)), {value})"
    if data_type == T.BinaryType():
        return f"if(octet_length({value}) > 64, sha2({value}, 256), hex({value}))"
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return (
            f"if({value} IS NULL, NULL, sha2(cast(concat(hex(xxhash64({value})), "
            f"to_json(named_struct('v', {_summed(data_type, value)}), "
            f"map('ignoreNullFields', 'false', "
            f"'timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSSXXX', "
            f"'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS'))) AS binary), 256))"
        )
    return value


def _summed(data_type: T.DataType, value: str) -> str:
    """The value with zeros of one sign only, as grouping sees them."""
    if isinstance(data_type, T.ArrayType) and isinstance(
        data_type.elementType, (T.FloatType, T.DoubleType)
    ):
        return f"transform({value}, x -> if(x = 0, abs(x), x))"
    return value


def _problem(df: DataFrame, name: str, accepts=None, wanted: str = "") -> str | None:
    """Why a check cannot run on a column; None if it can."""
    found = df.columns.count(name)
    if found == 0:
        return f"column {name} not found"
    if found > 1:
        return f"column name {name} is ambiguous"
    if accepts is not None and not accepts(df.schema[name].dataType):
        return f"column {name} is {df.schema[name].dataType.simpleString()}, not {wanted}"
    return None


# ---------------------------------------------------------------- findings


def completeness_findings(
    df: DataFrame, m: Measures, columns: Iterable[str] | None, limits: Limits
) -> list[Finding]:
    out = []
    for name in df.columns if columns is None else columns:
        label = f"Completeness of {name}"
        if problem := _problem(df, name):
            out.append(Finding("completeness", name, label, error=problem))
            continue
        n, missing = total(m), nulls(m, name)
        share = ratio(f"{n} - {missing}", n)
        out.append(
            Finding(
                "completeness",
                name,
                label,
                f"{share} >= {number(limits.completeness_min)}",
                {"completeness_ratio": share, "null_count": missing, "total_count": n},
            )
        )
    return out


def uniqueness_findings(
    df: DataFrame,
    m: Measures,
    columns: Iterable[str] | None,
    limits: Limits,
    count_null: bool = False,
) -> list[Finding]:
    """Distinct non-null values over all rows; with ``count_null`` missing counts as one."""
    out = []
    for name in df.columns if columns is None else columns:
        label = f"Uniqueness of {name}"
        if problem := _problem(df, name, countable, "a type with comparable values"):
            out.append(Finding("uniqueness", name, label, error=problem))
            continue
        n, values = total(m), distinct(m, df, name)
        if count_null:
            values = f"({values} + IF({nulls(m, name)} > 0, 1, 0))"
        share = ratio(values, n)
        out.append(
            Finding(
                "uniqueness",
                name,
                label,
                f"{share} >= {number(limits.uniqueness_min)}",
                {"uniqueness_ratio": share, "distinct_count": values, "total_count": n},
            )
        )
    return out


def consistency_findings(
    df: DataFrame, m: Measures, columns: Iterable[str] | None, limits: Limits
) -> list[Finding]:
    """No negative and no absurdly large numbers."""
    out = []
    for name in numeric_columns(df) if columns is None else columns:
        label = f"Consistency of {name}"
        if problem := _problem(df, name, is_numeric, "numeric"):
            out.append(Finding("consistency", name, label, error=problem))
            continue
        n = total(m)
        negative = m.count_if(name, f"{quoted(name)} < 0")
        huge = m.count_if(name, f"{quoted(name)} > {number(limits.outlier_above)}")
        out.append(
            Finding(
                "consistency",
                name,
                label,
                f"{negative} = 0 AND {huge} = 0",
                {
                    "negative_ratio": ratio(negative, n),
                    "outlier_ratio": ratio(huge, n),
                    "negative_count": negative,
                    "outlier_count": huge,
                    "total_count": n,
                },
            )
        )
    return out


def _bound(data_type: T.DataType, bound: Any) -> str | None:
    """SQL text of a bound, or None if the column cannot be compared with it."""
    if is_numeric(data_type) and not isinstance(bound, bool):
        if isinstance(bound, numbers.Integral):
            return str(int(bound))
        if isinstance(bound, decimal.Decimal):
            return f"{bound:f}BD"
        return number(float(bound)) if isinstance(bound, numbers.Real) else None
    if is_text(data_type) and isinstance(bound, str):
        return text(bound)
    if isinstance(bound, datetime.date):
        kind = {
            T.DateType: "DATE",
            T.TimestampType: "TIMESTAMP",
            T.TimestampNTZType: "TIMESTAMP_NTZ",
        }.get(type(data_type))
        return f"CAST({text(str(bound))} AS {kind})" if kind else None
    return None


def range_findings(
    df: DataFrame, m: Measures, ranges: Ranges, limits: Limits
) -> list[Finding]:
    """Values below ``min`` plus values above ``max``, either bound optional."""
    out = []
    for name, bounds in ranges.items():
        label = f"Range check for {name}"
        given = {k: bounds[k] for k in ("min", "max") if bounds.get(k) is not None}
        params = {k: str(v) for k, v in given.items()}
        problem, literals = _problem(df, name), {}
        if problem is None:
            data_type = df.schema[name].dataType
            literals = {side: _bound(data_type, b) for side, b in given.items()}
            for side in (s for s, literal in literals.items() if literal is None):
                problem = (
                    f"{side} {given[side]!r} cannot be compared with column {name} "
                    f"of type {data_type.simpleString()}"
                )
        if problem:
            out.append(
                Finding("range_check", name, label, params=params, error=problem)
            )
            continue
        n = total(m)
        sides = [
            m.count_if(name, f"{quoted(name)} {sign} {literals[side]}")
            for side, sign in (("min", "<"), ("max", ">"))
            if side in literals
        ]
        violations = f"({' + '.join(sides) or '0'})"
        out.append(
            Finding(
                "range_check",
                name,
                label,
                f"{violations} = 0",
                {
                    "violation_ratio": ratio(violations, n),
                    "violations": violations,
                    "total_count": n,
                },
                params,
            )
        )
    return out


def _pattern_problem(spark: SparkSession, pattern: str) -> str | None:
    """A pattern that does not compile must not take the other checks down with it."""
    try:
        # on literal rows this is evaluated while planning, without a job
        spark.sql(f"SELECT col1 RLIKE {text(pattern)} FROM VALUES ('x')").collect()
    except PySparkException as error:
        return f"pattern {pattern!r} is not valid: {type(error).__name__}"
    return None


def pattern_findings(
    df: DataFrame, m: Measures, patterns: Patterns, limits: Limits
) -> list[Finding]:
    """Non-null values in which the regular expression is not found."""
    out = []
    for name, pattern in patterns.items():
        label = f"Pattern check for {name}"
        params = {"pattern": pattern}
        problem = _problem(df, name, is_text, "string") or _pattern_problem(
            df.sparkSession, pattern
        )
        if problem:
            out.append(
                Finding("pattern_check", name, label, params=params, error=problem)
            )
            continue
        n = total(m)
        violations = m.count_if(name, f"NOT {quoted(name)} RLIKE {text(pattern)}")
        out.append(
            Finding(
                "pattern_check",
                name,
                label,
                f"{violations} = 0",
                {
                    "violation_ratio": ratio(violations, n),
                    "violations": violations,
                    "total_count": n,
                },
                params,
            )
        )
    return out


def text_findings(
    df: DataFrame, m: Measures, columns: Iterable[str] | None, limits: Limits
) -> list[Finding]:
    """Shares of missing, empty, short and long texts; an empty text is also short."""
    out = []
    for name in text_columns(df) if columns is None else columns:
        label = f"Text quality for {name}"
        if problem := _problem(df, name, is_text, "string"):
            out.append(Finding("text_quality", name, label, error=problem))
            continue
        n, value = total(m), quoted(name)
        counts = {
            "null": nulls(m, name),
            "empty": m.count_if(name, f"octet_length({value}) = 0"),
            "short": m.count_if(name, shorter_than(value, limits.short_chars)),
            "long": m.count_if(name, longer_than(value, limits.long_chars)),
        }
        allowed = {
            "null": limits.null_text_max,
            "empty": limits.empty_text_max,
            "short": limits.short_text_max,
            "long": limits.long_text_max,
        }
        shares = {kind: ratio(count, n) for kind, count in counts.items()}
        out.append(
            Finding(
                "text_quality",
                name,
                label,
                " AND ".join(
                    f"{shares[kind]} <= {number(most)}" for kind, most in allowed.items()
                ),
                {f"{kind}_ratio": share for kind, share in shares.items()}
                | {f"{kind}_count": count for kind, count in counts.items()}
                | {"total_count": n},
            )
        )
    return out


def mail_findings(
    df: DataFrame, m: Measures, mail: MailColumns, limits: Limits
) -> list[Finding]:
    """Address shape, spam phrases and sentiment domain, for the columns that exist."""
    rules = (
        (
            mail.sender,
            "Email format validity",
            "invalid_email",
            bad_email,
            limits.bad_email_max,
            (is_text, "string"),
        ),
        (
            mail.subject,
            "Spam indicator detection",
            "spam",
            looks_like_spam,
            limits.spam_max,
            (is_text, "string"),
        ),
        (
            mail.sentiment,
            "Sentiment score validity",
            "invalid_sentiment",
            lambda c: outside(c, limits.sentiment_low, limits.sentiment_high),
            limits.bad_sentiment_max,
            (is_numeric, "numeric"),
        ),
    )
    out = []
    for name, label, metric, test, allowed, (accepts, wanted) in rules:
        if name not in df.columns:
            continue
        if problem := _problem(df, name, accepts, wanted):
            out.append(Finding("email_specific", name, label, error=problem))
            continue
        n = total(m)
        hits = m.count_if(name, test(quoted(name)))
        share = ratio(hits, n)
        out.append(
            Finding(
                "email_specific",
                name,
                label,
                f"{share} < {number(allowed)}",
                {f"{metric}_ratio": share, f"{metric}_count": hits, "total_count": n},
            )
        )
    return out


# ---------------------------------------------------------------- single checks


def _flat(
    results: DataFrame,
    shares: Sequence[str],
    counts: Sequence[str],
    params: Sequence[str] = (),
) -> DataFrame:
    return results.selectExpr(
        "constraint",
        "column_name",
        "status",
        *[f"metrics['{name}'] AS {name}" for name in shares],
        *[f"CAST(metrics['{name}'] AS BIGINT) AS {name}" for name in counts],
        *[f"params['{name}'] AS {name}" for name in params],
        "params['error'] AS error",
    )


def completeness(
    df: DataFrame, columns: Iterable[str] | None = None, limits: Limits = Limits()
) -> DataFrame:
    df, m = normalise(df), Measures()
    found = completeness_findings(df, m, columns, limits)
    return _flat(
        findings_frame(df, m, found),
        ["completeness_ratio"],
        ["null_count", "total_count"],
    )


def uniqueness(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    limits: Limits = Limits(),
    approx_distinct_error: float | None = None,
    distinct_batch: int = DISTINCT_BATCH,
    count_null: bool = False,
) -> DataFrame:
    """Exact unless ``approx_distinct_error`` (a relative standard deviation) is given.

    With ``count_null`` a column with missing cells has one distinct value more.
    """
    df, m = normalise(df), Measures(approx_distinct_error)
    found = uniqueness_findings(df, m, columns, limits, count_null)
    return _flat(
        findings_frame(df, m, found, distinct_batch),
        ["uniqueness_ratio"],
        ["distinct_count", "total_count"],
    )


def consistency(
    df: DataFrame, columns: Iterable[str] | None = None, limits: Limits = Limits()
) -> DataFrame:
    df, m = normalise(df), Measures()
    found = consistency_findings(df, m, columns, limits)
    return _flat(
        findings_frame(df, m, found),
        ["negative_ratio", "outlier_ratio"],
        ["negative_count", "outlier_count", "total_count"],
    )


def range_check(
    df: DataFrame, ranges: Ranges, limits: Limits = Limits()
) -> DataFrame:
    df, m = normalise(df), Measures()
    found = range_findings(df, m, ranges, limits)
    return _flat(
        findings_frame(df, m, found),
        ["violation_ratio"],
        ["violations", "total_count"],
        ["min", "max"],
    )


def pattern_check(
    df: DataFrame, patterns: Patterns, limits: Limits = Limits()
) -> DataFrame:
    df, m = normalise(df), Measures()
    found = pattern_findings(df, m, patterns, limits)
    return _flat(
        findings_frame(df, m, found),
        ["violation_ratio"],
        ["violations", "total_count"],
        ["pattern"],
    )


def text_quality(
    df: DataFrame, columns: Iterable[str] | None = None, limits: Limits = Limits()
) -> DataFrame:
    df, m = normalise(df), Measures()
    found = text_findings(df, m, columns, limits)
    kinds = ("null", "empty", "short", "long")
    return _flat(
        findings_frame(df, m, found),
        [f"{kind}_ratio" for kind in kinds],
        [*[f"{kind}_count" for kind in kinds], "total_count"],
    )


def mail_checks(
    df: DataFrame, mail: MailColumns = MailColumns(), limits: Limits = Limits()
) -> DataFrame:
    """All mail checks in one pass, each as (constraint, ratio, count, total, status)."""
    df, m = normalise(df), Measures()
    results = findings_frame(df, m, mail_findings(df, m, mail, limits))
    kinds = ("invalid_email", "spam", "invalid_sentiment")
    shares = ", ".join(f"metrics['{kind}_ratio']" for kind in kinds)
    counts = ", ".join(f"metrics['{kind}_count']" for kind in kinds)
    return results.selectExpr(
        "constraint",
        "column_name",
        "status",
        f"coalesce({shares}) AS violation_ratio",
        f"CAST(coalesce({counts}) AS BIGINT) AS violations",
        "CAST(metrics['total_count'] AS BIGINT) AS total_count",
        "params['error'] AS error",
    )


def email_format(
    df: DataFrame, column: str = "sender_email", limits: Limits = Limits()
) -> DataFrame:
    return mail_checks(df.select(col(column)), MailColumns(sender=column), limits)


def spam_indicator(
    df: DataFrame, column: str = "subject", limits: Limits = Limits()
) -> DataFrame:
    return mail_checks(df.select(col(column)), MailColumns(subject=column), limits)


def sentiment_validity(
    df: DataFrame, column: str = "sentiment_score", limits: Limits = Limits()
) -> DataFrame:
    return mail_checks(df.select(col(column)), MailColumns(sentiment=column), limits)


__all__ = [
    "Limits",
    "MailColumns",
    "completeness",
    "consistency",
    "email_format",
    "mail_checks",
    "pattern_check",
    "range_check",
    "sentiment_validity",
    "spam_indicator",
    "text_quality",
    "uniqueness",
]
