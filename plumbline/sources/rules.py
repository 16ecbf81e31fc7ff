"""Alert rules that outlast the session, as a versioned table.

Adding, changing and removing a rule each append one small row; the newest row of a name
holds. Rows are never changed, so the history of a rule can be read, and a running stream
that reads the table per cycle takes up what was added since.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.alerts import AlertRule

RULES = (
    "name string, check_type string, metric string, op string, value double, "
    "actions array<string>, severity string, column_name string, created_at timestamp, "
    "version string, removed boolean"
)


class RuleTable:
    """Rules below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def history(self) -> DataFrame:
        """All versions of all rules."""
        try:
            return self.spark.read.schema(RULES).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RULES)

    def current(self) -> DataFrame:
        """The newest version of every rule that was not removed."""
        newest = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("version"))
        return (
            self.history()
            .withColumn("place", F.row_number().over(newest))
            .where("place = 1 AND NOT removed")
            .drop("place", "removed")
        )

    def rules(self) -> tuple[AlertRule, ...]:
        """The rules that hold now, by name: as many rows as people have written."""
        return tuple(
            AlertRule(
                r.name, r.check_type, r.metric, r.op, r.value, tuple(r.actions), r.severity, r.column_name
            )
            for r in self.current().orderBy("name").collect()
        )

    def add(self, rule: AlertRule, created_at: datetime.datetime | None = None) -> None:
        """Adds a rule, or a new version of the rule of that name."""
        rule.holds()  # an unknown comparison is refused before it is stored
        self._append(rule, created_at, False)

    def remove(self, name: str, created_at: datetime.datetime | None = None) -> None:
        """No alert is raised for it from the next cycle on; its versions stay readable."""
        for rule in self.rules():
            if rule.name == name:
                self._append(rule, created_at, True)

    def _append(self, rule: AlertRule, created_at: datetime.datetime | None, removed: bool) -> None:
        row = (
            rule.name, rule.check_type, rule.metric, rule.op, float(rule.value), list(rule.actions),
            rule.severity, rule.column_name, created_at or datetime.datetime.now(), uuid.uuid4().hex, removed,
        )
        self.spark.createDataFrame([row], RULES).coalesce(1).write.mode("append").parquet(self.path)
