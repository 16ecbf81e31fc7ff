"""Alerts: rows derived from runs, check results and anomaly counts.

Every function returns rows of the same layout (:data:`plumbline.sources.store.ALERT_FIELDS`).
Inputs carry ``run_id``, ``dataset_name`` and ``timestamp``, as the stored tables do.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.operators.checks import Limits
from plumbline.plans.findings import ERROR, FAILURE
from plumbline.sources.store import ALERT_FIELDS

# The wording of alerts; {} stands for the measured text.
LOW_SCORE = "Data quality score ({}%) is below threshold ({}%)"
FAILED_COMPLETENESS = "Completeness check failed for column: {}"
FAILED_UNIQUENESS = "Uniqueness check failed for column: {}"
MANY_ANOMALIES = "High anomaly percentage ({}%) detected in column: {}"
CHECK_ERROR = "Error in quality threshold checking: {}"
MESSAGE_SUBJECT = "Data Quality Alert: {}"

# ---------------------------------------------------------------- configuration


@dataclass(frozen=True)
class EmailChannel:
    enabled: bool = False
    smtp_server: str = "smtp.gmail.com"
    smtp_port: int = 587
    username: str = ""
    password: str = field(default="", repr=False)
    recipients: tuple[str, ...] = ()


@dataclass(frozen=True)
class WebhookChannel:
    enabled: bool = False
    url: str = ""
    headers: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Thresholds:
    """Percentages."""

    quality_score_min: float = 80.0
    anomaly_percentage_max: float = 5.0
    completeness_min: float = 95.0
    uniqueness_min: float = 90.0

    def limits(self, base: Limits = Limits()) -> Limits:
        """The check limits these thresholds ask for."""
        return replace(
            base,
            completeness_min=self.completeness_min / 100,
            uniqueness_min=self.uniqueness_min / 100,
        )


@dataclass(frozen=True)
class Schedule:
    enabled: bool = False
    interval_minutes: int = 60


@dataclass(frozen=True)
class AlertConfig:
    email: EmailChannel = EmailChannel()
    webhook: WebhookChannel = WebhookChannel()
    thresholds: Thresholds = Thresholds()
    schedule: Schedule = Schedule()

    def updated(self, **sections) -> AlertConfig:
        """A copy with whole sections replaced."""
        return replace(self, **sections)

    def channels(self) -> dict[str, list[str]]:
        """Enabled channels and whom each of them addresses."""
        out: dict[str, list[str]] = {}
        if self.email.enabled:
            out["email"] = list(self.email.recipients)
        if self.webhook.enabled:
            out["webhook"] = [self.webhook.url]
        return out


@dataclass(frozen=True)
class AlertRule:
    """Alert when ``metric`` of a check compares to ``value`` as ``op`` says.

    ``actions`` names the channels the alert goes to; none means every enabled one.
    """

    name: str
    check_type: str
    metric: str
    op: str
    value: float
    actions: tuple[str, ...] = ()
    severity: str = "medium"
    column_name: str | None = None

    def holds(self) -> Column:
        measured = F.col("metrics")[self.metric]
        compare = {
            "<": measured < self.value,
            "<=": measured <= self.value,
            ">": measured > self.value,
            ">=": measured >= self.value,
            "==": measured == self.value,
            "!=": measured != self.value,
        }
        if self.op not in compare:
            raise ValueError(f"unknown comparison {self.op!r}")
        condition = (F.col("check_type") == self.check_type) & compare[self.op]
        if self.column_name is not None:
            condition = condition & (F.col("column_name") == self.column_name)
        return condition


# ---------------------------------------------------------------- deriving alerts


def worded(template: str, *parts: Column) -> Column:
    """The template with its gaps filled."""
    texts = [F.lit(piece) for piece in template.split("{}")]
    filled = [c for pair in zip(texts, parts) for c in pair]
    return F.concat(*filled, *texts[len(parts) :])


def _alerts(rows: DataFrame, **fields: Column) -> DataFrame:
    """Alert rows of the common layout; fields not given are NULL."""
    fields = {name: F.col(name) for name in ("run_id", "dataset_name")} | fields
    fields.setdefault("timestamp", F.col("timestamp"))
    return rows.select(
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            if name != "timestamp"
            else fields[name].alias(name)
            for name, kind in ALERT_FIELDS.items()
        ]
    )


def score_alerts(runs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Runs whose score is below the minimum."""
    least = thresholds.quality_score_min
    score = F.col("quality_score")
    return _alerts(
        runs.filter(score < least),
        type=F.lit("quality_score_low"),
        severity=F.lit("high"),
        message=worded(LOW_SCORE, fixed(score, 2), F.lit(str(least))),
        value=score,
        threshold=F.lit(least),
    )


_RESULT_FIELDS = ("type", "severity", "message", "value", "threshold", "actions")


def _outcome(condition: Column, **fields: Column) -> Column:
    """One alert of a result row if the condition holds, else NULL."""
    return F.when(
        condition,
        F.struct(
            *[
                fields.get(name, F.lit(None)).cast(ALERT_FIELDS[name]).alias(name)
                for name in _RESULT_FIELDS
            ]
        ),
    )


def _failure(check_type: str, wording: str) -> Column:
    return _outcome(
        (F.col("check_type") == check_type) & (F.col("status") == FAILURE),
        type=F.lit(f"{check_type}_failure"),
        severity=F.lit("medium"),
        message=worded(wording, F.col("constraint")),
    )


def _system() -> Column:
    return _outcome(
        F.col("status") == ERROR,
        type=F.lit("system_error"),
        severity=F.lit("high"),
        message=worded(CHECK_ERROR, F.col("params")["error"]),
    )


def _rule(rule: AlertRule) -> Column:
    actions = F.array(*[F.lit(a) for a in rule.actions]) if rule.actions else F.lit(None)
    return _outcome(
        rule.holds(),
        type=F.lit(rule.name),
        severity=F.lit(rule.severity),
        message=F.concat(
            F.lit(f"Rule {rule.name}: {rule.metric} {rule.op} {rule.value} in "),
            F.col("constraint"),
        ),
        value=F.col("metrics")[rule.metric],
        threshold=F.lit(float(rule.value)),
        actions=actions,
    )


def _raised(results: DataFrame, outcomes: list[Column]) -> DataFrame:
    """The outcomes that hold, one row each, in a single pass over the results."""
    if not outcomes:
        return _alerts(results.limit(0))
    hits = results.select(
        "run_id", "dataset_name", "timestamp", "column_name",
        F.explode(F.array_compact(F.array(*outcomes))).alias("alert"),
    )
    return _alerts(
        hits,
        column_name=F.col("column_name"),
        **{name: F.col("alert")[name] for name in _RESULT_FIELDS},
    )


def completeness_alerts(results: DataFrame) -> DataFrame:
    return _raised(results, [_failure("completeness", FAILED_COMPLETENESS)])


def uniqueness_alerts(results: DataFrame) -> DataFrame:
    return _raised(results, [_failure("uniqueness", FAILED_UNIQUENESS)])


def system_alerts(results: DataFrame) -> DataFrame:
    """Checks that could not be evaluated."""
    return _raised(results, [_system()])


def anomaly_alerts(
    counts: DataFrame, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """Columns with more anomalies than allowed."""
    share = F.col("anomaly_percentage")
    most = thresholds.anomaly_percentage_max
    return _alerts(
        counts.filter(share > most),
        type=F.lit("anomaly_detected"),
        severity=F.lit("high"),
        message=worded(MANY_ANOMALIES, fixed(share, 2), F.col("column_name")),
        column_name=F.col("column_name"),
        anomaly_percentage=share,
        anomaly_count=F.col("anomaly_count"),
    )


def rule_alerts(results: DataFrame, rules: Iterable[AlertRule]) -> DataFrame:
    """One alert per result row and rule that holds; all rules in one pass."""
    return _raised(results, [_rule(rule) for rule in rules])


def result_alerts(results: DataFrame, rules: Iterable[AlertRule] = ()) -> DataFrame:
    """Completeness, uniqueness, system and rule alerts in one pass over the results."""
    fixed_ones = [
        _failure("completeness", FAILED_COMPLETENESS),
        _failure("uniqueness", FAILED_UNIQUENESS),
        _system(),
    ]
    return _raised(results, fixed_ones + [_rule(rule) for rule in rules])


def quality_alerts(
    runs: DataFrame,
    results: DataFrame,
    thresholds: Thresholds = Thresholds(),
    rules: Iterable[AlertRule] = (),
) -> DataFrame:
    """Score alerts of the runs and all alerts of their results."""
    return union_alerts(score_alerts(runs, thresholds), result_alerts(results, rules))


def union_alerts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- summary, delivery


def alert_summary(
    alerts: DataFrame, as_of: datetime.datetime | Column, hours: float = 24
) -> DataFrame:
    """Alerts later than ``hours`` before ``as_of``: in total, by type and by severity.

    Rows are (grouping, value, alerts) with grouping ``total``, ``type`` or ``severity``.
    """
    period = F.lit(datetime.timedelta(hours=hours))
    recent = alerts.filter(F.col("timestamp") > F.lit(as_of) - period)
    pairs = recent.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("alerts"))
    unfolded = pairs.selectExpr(
        "inline(array("
        "named_struct('grouping', 'total', 'value', CAST(NULL AS STRING)), "
        "named_struct('grouping', 'type', 'value', type), "
        "named_struct('grouping', 'severity', 'value', severity)))",
        "alerts",
    )
    # the total is there even when no alert is
    none = alerts.sparkSession.createDataFrame([("total", None, 0)], unfolded.schema)
    return (
        unfolded.unionByName(none)
        .groupBy("grouping", "value")
        .agg(F.sum("alerts").alias("alerts"))
    )


def outbox(alerts: DataFrame, config: AlertConfig) -> DataFrame:
    """One rendered message per alert and enabled channel.

    An alert that names its ``actions`` goes to those of them that are enabled.
    """
    channels = config.channels()
    routes = [
        F.struct(
            F.lit(name).alias("channel"),
            F.array(*[F.lit(r) for r in to]).cast("array<string>").alias("recipients"),
        )
        for name, to in channels.items()
    ]
    if not routes:
        alerts = alerts.limit(0)
        routes = [
            F.struct(
                F.lit("").alias("channel"),
                F.array().cast("array<string>").alias("recipients"),
            )
        ]
    payload = F.to_json(F.struct(*[F.col(name) for name in ALERT_FIELDS]))
    routed = alerts.select(
        *[F.col(name) for name in ALERT_FIELDS], F.inline(F.array(*routes))
    ).filter(
        F.col("actions").isNull() | F.array_contains("actions", F.col("channel"))
    )
    return routed.select(
        "*",
        worded(MESSAGE_SUBJECT, F.col("type")).alias("subject"),
        F.concat_ws(
            "\n",
            F.lit("Data Quality Alert"),
            F.lit(""),
            F.concat(F.lit("Type: "), F.col("type")),
            F.concat(F.lit("Severity: "), F.col("severity")),
            F.concat(F.lit("Message: "), F.col("message")),
            F.concat(
                F.lit("Timestamp: "),
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
            ),
            F.lit(""),
            F.lit("Additional Details:"),
            payload,
        ).alias("body"),
        payload.alias("payload"),
    )
