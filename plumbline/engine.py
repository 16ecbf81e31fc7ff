"""Quality checks and alerting behind two objects that share a store.

The operators can be used on their own; these classes tie them to a run history.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import alerts as A
from plumbline.operators import anomalies, checks, profile, runs, suite
from plumbline.operators.checks import Limits, Patterns, Ranges
from plumbline.sources.rules import RuleTable
from plumbline.sources.store import RunStore, new_run_id
from plumbline.sources.tables import from_pandas
from plumbline.streaming.monitor import Cycle, run_cycle, start_monitoring


@dataclass(frozen=True)
class SuiteRun:
    """Results of a suite; ``run_id`` and ``quality_score`` are set once it is saved."""

    results: DataFrame
    run_id: str | None = None
    quality_score: float | None = None


class QualityEngine:
    def __init__(
        self, spark: SparkSession, store_path: str, limits: Limits = Limits()
    ) -> None:
        self.spark = spark
        self.store = RunStore(spark, store_path)
        self.base_limits = limits
        self.center: AlertCenter | None = None

    @property
    def limits(self) -> Limits:
        """What checks measure against; an alert center's thresholds go before."""
        return self.base_limits if self.center is None else self.center.limits

    def table(self, data: Any, view: str | None = None) -> DataFrame:
        """Accept a DataFrame as it is and a pandas frame by conversion."""
        if isinstance(data, DataFrame):
            if view is not None:
                data.createOrReplaceTempView(view)
            return data
        return from_pandas(self.spark, data, view)

    # ------------------------------------------------------------ checks

    def run_completeness_check(self, df, columns: Iterable[str] | None = None):
        return checks.completeness(self.table(df), columns, self.limits)

    def run_uniqueness_check(
        self,
        df,
        columns: Iterable[str] | None = None,
        approx_distinct_error: float | None = None,
        count_null: bool = False,
    ):
        return checks.uniqueness(
            self.table(df), columns, self.limits, approx_distinct_error, count_null=count_null
        )

    def run_consistency_check(self, df, columns: Iterable[str] | None = None):
        return checks.consistency(self.table(df), columns, self.limits)

    def run_range_check(self, df, column_ranges: Ranges):
        return checks.range_check(self.table(df), column_ranges, self.limits)

    def run_pattern_check(self, df, pattern_columns: Patterns):
        return checks.pattern_check(self.table(df), pattern_columns, self.limits)

    def run_text_quality_check(self, df, columns: Iterable[str] | None = None):
        return checks.text_quality(self.table(df), columns, self.limits)

    def run_email_specific_check(self, df, mail: checks.MailColumns | None = None):
        return checks.mail_checks(
            self.table(df), mail or checks.MailColumns(), self.limits
        )

    def generate_data_profile(self, df):
        return profile.column_profile(self.table(df))

    def suggest_constraints(self, df):
        return profile.suggest_constraints(self.table(df))

    def calculate_quality_score(self, results: DataFrame) -> DataFrame:
        return suite.quality_score(results)

    def detect_anomalies(
        self, df, columns: Sequence[str] | None = None, threshold: float = 2.0
    ):
        return anomalies.detect_anomalies(self.table(df), columns, threshold)

    def run_comprehensive_quality_check(
        self,
        df,
        column_ranges: Ranges | None = None,
        pattern_columns: Patterns | None = None,
        dataset_name: str = "unknown_dataset",
        save_metrics: bool = True,
        timestamp: datetime.datetime | None = None,
        **options: Any,
    ) -> SuiteRun:
        """The whole suite; with ``save_metrics`` its results and its run are stored."""
        options.setdefault("limits", self.limits)
        results = suite.run_suite(
            self.table(df), column_ranges, pattern_columns, **options
        )
        if not save_metrics:
            return SuiteRun(results)
        run_id, timestamp = new_run_id(), timestamp or datetime.datetime.now()
        self.store.save_results(results, dataset_name, run_id, timestamp)
        saved = self.store.read_run("check_results", dataset_name, run_id)
        record = suite.run_record(
            saved,
            dataset_name,
            run_id,
            timestamp,
            self.store.table_path("check_results"),
        )
        self.store.write("runs", record, dataset_name, run_id)
        return SuiteRun(saved, run_id, record.first()["quality_score"])

    # ------------------------------------------------------------ history

    def get_run_history(
        self, dataset_name: str | None = None, limit: int | None = None
    ) -> DataFrame:
        return runs.run_history(self.store.runs(dataset_name), dataset_name, limit)

    def get_run_metrics(self, run_id: str, dataset_name: str | None = None) -> DataFrame:
        """Check results of a run; its id alone is enough to find its partition."""
        return self.store.run_metrics(run_id, dataset_name)

    def download_metrics_json(
        self, run_id: str, path: str, dataset_name: str | None = None
    ) -> None:
        self.store.export_metrics(run_id, path, dataset_name)

    def get_dataset_summary(self, dataset_name: str | None = None) -> DataFrame:
        return runs.dataset_summary(self.store.runs(dataset_name), dataset_name)

    def get_score_trend(self, n: int = 5, dataset_name: str | None = None) -> DataFrame:
        return runs.score_trend(self.store.runs(dataset_name), n)

    def get_recent_runs(self, n: int = 5, dataset_name: str | None = None) -> DataFrame:
        return runs.recent_runs(self.store.runs(dataset_name), n)


class AlertCenter:
    def __init__(
        self, engine: QualityEngine, config: A.AlertConfig = A.AlertConfig()
    ) -> None:
        self.engine = engine
        self.store = engine.store
        self.config = config
        self.rule_table = RuleTable(engine.spark, f"{engine.store.path}/alert_rules")
        engine.center = self

    @property
    def rules(self) -> dict[str, A.AlertRule]:
        """The rules kept in the store, by name."""
        return {rule.name: rule for rule in self.rule_table.rules()}

    @property
    def limits(self) -> Limits:
        """The engine's limits with the thresholds that alerts are raised at."""
        return self.config.thresholds.limits(self.engine.base_limits)

    def add_alert_rule(self, rule: A.AlertRule) -> None:
        """Keeps a rule; running streams of this store take it up with their next batch."""
        self.rule_table.add(rule)

    def remove_alert_rule(self, name: str) -> None:
        self.rule_table.remove(name)

    def check_quality_thresholds(
        self, run_id: str, dataset_name: str | None = None
    ) -> DataFrame:
        """Alerts of a saved run; with its dataset only its own folders are read."""
        record = self.store.of_run("runs", run_id, dataset_name)
        return A.quality_alerts(
            record,
            self.store.run_metrics(run_id, dataset_name),
            self.config.thresholds,
            self.rules.values(),
        )

    def check_anomaly_thresholds(
        self,
        counts: DataFrame,
        dataset_name: str = "unknown_dataset",
        run_id: str | None = None,
        timestamp: datetime.datetime | None = None,
    ) -> DataFrame:
        """Alerts on anomaly counts, under the given run or one of their own."""
        stamp = F.lit(timestamp or datetime.datetime.now()).cast("timestamp")
        return A.anomaly_alerts(
            counts.withColumns(
                {
                    "dataset_name": F.lit(dataset_name),
                    "run_id": F.lit(run_id or new_run_id()),
                    "timestamp": stamp,
                }
            ),
            self.config.thresholds,
        )

    def process_alerts(self, alerts: DataFrame) -> None:
        """Keep the alerts and put a message per enabled channel into the outbox.

        The alerts are evaluated once; messages are rendered from what was kept. Processing
        them a second time leaves one set of either.
        """
        kept = self.store.add_alerts(alerts)
        if self.config.channels():
            self.store.replace_runs("outbox", A.outbox(kept, self.config))

    def get_alert_summary(
        self, hours: float = 24, as_of: datetime.datetime | None = None
    ) -> DataFrame:
        """Counts of the period's alerts; only the months it touches are read."""
        as_of = as_of or datetime.datetime.now()
        since = as_of - datetime.timedelta(hours=hours)
        return A.alert_summary(self.store.alerts(since), as_of, hours)

    def clear_alert_history(self) -> None:
        self.store.clear_alerts()

    def update_config(self, **sections: Any) -> None:
        self.config = self.config.updated(**sections)

    def get_config(self) -> A.AlertConfig:
        return self.config

    def run_once(
        self, source: Callable[[], Any], dataset_name: str, **options: Any
    ) -> Cycle:
        """One monitoring cycle over what ``source`` returns."""
        options.setdefault("limits", self.limits)
        return run_cycle(
            self.engine.table(source()),
            dataset_name,
            self.store,
            self.config,
            self.rules.values(),
            **options,
        )

    def start_monitoring(
        self, stream: DataFrame, dataset_name: str, **options: Any
    ) -> StreamingQuery:
        options.setdefault("limits", self.limits)
        return start_monitoring(
            stream,
            dataset_name,
            self.store,
            self.config,
            self.rule_table,
            **options,
        )
