import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.engine import AlertCenter, QualityEngine
from plumbline.operators import alerts as A

NOW = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def engine(spark, tmp_path):
    return QualityEngine(spark, str(tmp_path / "store"))


@pytest.fixture
def center(engine):
    return AlertCenter(engine)


@pytest.fixture
def run(engine, people):
    return engine.run_comprehensive_quality_check(
        people, {"nowhere": {"min": 0}}, dataset_name="people", timestamp=NOW
    )


def test_quality_alerts_of_a_run(center, run):
    rows = center.check_quality_thresholds(run.run_id).collect()
    assert sorted((r.type, r.severity, r.message) for r in rows) == [
        ("completeness_failure", "medium", "Completeness check failed for column: Completeness of name"),
        ("quality_score_low", "high", "Data quality score (75.00%) is below threshold (80.0%)"),
        ("system_error", "high", "Error in quality threshold checking: column nowhere not found"),
        ("uniqueness_failure", "medium", "Uniqueness check failed for column: Uniqueness of name"),
    ]
    low = [r for r in rows if r.type == "quality_score_low"][0]
    assert (low.value, low.threshold, low.dataset_name, low.timestamp) == (75.0, 80.0, "people", NOW)


@pytest.mark.parametrize("least, alerts", [(75.0, 0), (75.01, 1)])
def test_score_threshold_is_strict(center, run, least, alerts):
    center.update_config(thresholds=A.Thresholds(quality_score_min=least))
    found = center.check_quality_thresholds(run.run_id)
    assert found.filter("type = 'quality_score_low'").count() == alerts


def test_anomaly_alerts(spark, center):
    counts = spark.createDataFrame(
        [("a", 5.0, 50), ("b", 5.126, 51), ("c", None, 0)],
        "column_name string, anomaly_percentage double, anomaly_count bigint",
    )
    rows = center.check_anomaly_thresholds(counts, "d", "r", NOW).collect()
    assert [(r.column_name, r.message, r.anomaly_count) for r in rows] == [
        ("b", "High anomaly percentage (5.13%) detected in column: b", 51)
    ]


def test_thresholds_reach_the_checks(people):
    from plumbline.operators.suite import run_suite

    limits = A.Thresholds(completeness_min=80.0, uniqueness_min=80.0).limits()
    failures = run_suite(people, limits=limits).filter("status = 'Failure'")
    assert [r.check_type for r in failures.collect()] == ["text_quality"]


def test_rules(center, run):
    center.add_alert_rule(A.AlertRule("gaps", "completeness", "null_count", ">", 0, ("webhook",)))
    center.add_alert_rule(A.AlertRule("never", "completeness", "null_count", ">", 99))
    center.add_alert_rule(
        A.AlertRule("unique_id", "uniqueness", "uniqueness_ratio", "==", 1.0, column_name="id", severity="low")
    )
    rows = center.check_quality_thresholds(run.run_id).filter(F.col("type").isin("gaps", "never", "unique_id"))
    assert sorted((r.type, r.severity, r.column_name, r.value, r.actions) for r in rows.collect()) == [
        ("gaps", "medium", "name", 1.0, ["webhook"]),
        ("unique_id", "low", "id", 1.0, None),
    ]
    with pytest.raises(ValueError):
        A.AlertRule("x", "y", "z", "~", 1).holds()


def test_history_summary_and_clearing(spark, center, run):
    found = center.check_quality_thresholds(run.run_id)
    center.process_alerts(found)
    old = found.limit(1).withColumns(
        {"timestamp": F.lit(NOW - datetime.timedelta(hours=24)), "type": F.lit("old")}
    )
    center.process_alerts(old)
    assert center.store.alerts().count() == 5

    def summary(hours):
        rows = center.get_alert_summary(hours, as_of=NOW).collect()
        return {(r.grouping, r.value): r.alerts for r in rows}

    # strictly later than 24 hours ago: the old alert is just not
    assert summary(24) == {
        ("total", None): 4,
        ("type", "quality_score_low"): 1,
        ("type", "completeness_failure"): 1,
        ("type", "uniqueness_failure"): 1,
        ("type", "system_error"): 1,
        ("severity", "high"): 2,
        ("severity", "medium"): 2,
    }
    assert summary(25)["total", None] == 5
    center.clear_alert_history()
    assert center.store.alerts().count() == 0
    assert summary(25) == {("total", None): 0}
    center.process_alerts(found)
    assert center.store.alerts().count() == 4


def test_outbox(center, run):
    found = center.check_quality_thresholds(run.run_id)
    center.process_alerts(found)
    assert center.store.read("outbox").count() == 0
    center.update_config(
        email=A.EmailChannel(enabled=True, recipients=("a@b.cd", "e@f.gh"), password="secret"),
        webhook=A.WebhookChannel(enabled=True, url="https://example.com/hook"),
    )
    center.add_alert_rule(A.AlertRule("gaps", "completeness", "null_count", ">", 0, ("webhook",)))
    center.process_alerts(center.check_quality_thresholds(run.run_id))
    rows = center.store.read("outbox").collect()
    assert len(rows) == 2 * 4 + 1
    assert [r.channel for r in rows if r.type == "gaps"] == ["webhook"]
    low = [r for r in rows if r.type == "quality_score_low" and r.channel == "email"][0]
    assert low.subject == "Data Quality Alert: quality_score_low"
    assert low.recipients == ["a@b.cd", "e@f.gh"]
    assert low.body.startswith(
        "Data Quality Alert\n\nType: quality_score_low\nSeverity: high\n"
        "Message: Data quality score (75.00%) is below threshold (80.0%)\n"
        "Timestamp: 2024-05-01T12:00:00\n\nAdditional Details:\n{"
    )
    assert json.loads(low.payload)["value"] == 75.0
    assert not [r for r in rows if "secret" in r.body]


def test_config_defaults_and_updates():
    config = A.AlertConfig()
    assert config.thresholds == A.Thresholds(80.0, 5.0, 95.0, 90.0)
    assert (config.email.smtp_server, config.email.smtp_port) == ("smtp.gmail.com", 587)
    assert (config.schedule.enabled, config.schedule.interval_minutes) == (False, 60)
    assert config.channels() == {}
    changed = config.updated(schedule=A.Schedule(True, 5))
    assert changed.schedule.interval_minutes == 5
    assert changed.thresholds == config.thresholds
    assert "secret" not in repr(A.EmailChannel(password="secret"))
