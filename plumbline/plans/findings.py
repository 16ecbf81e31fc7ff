"""From measured numbers to rows of check results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from plumbline.functions import text
from plumbline.plans.measures import DISTINCT_BATCH, Measures

SUCCESS = "Success"
FAILURE = "Failure"
ERROR = "Error"


@dataclass(frozen=True)
class Finding:
    """One result row, as SQL text over the row of ``Measures.frame``.

    ``passed`` None means the row carries information only (profile, suggestion) and has
    no status. ``error`` set means the check could not be run on this column.
    """

    check_type: str
    column_name: str | None
    constraint: str
    passed: str | None = None
    metrics: dict[str, str] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    error: str | None = None

    def struct(self) -> str:
        if self.error is not None:
            status = text(ERROR)
        elif self.passed is None:
            status = text(None)
        else:
            status = f"if({self.passed}, {text(SUCCESS)}, {text(FAILURE)})"
        params = dict(self.params)
        if self.error is not None:
            params["error"] = self.error
        metrics = {k: f"CAST({v} AS DOUBLE)" for k, v in self.metrics.items()}
        params = {k: text(v) for k, v in params.items()}
        return (
            f"named_struct('check_type', {text(self.check_type)}, "
            f"'column_name', {text(self.column_name)}, "
            f"'constraint', {text(self.constraint)}, 'status', {status}, "
            f"'metrics', {_map(metrics, 'DOUBLE')}, "
            f"'params', {_map(params, 'STRING')})"
        )


def _map(entries: dict[str, str], value_type: str) -> str:
    pairs = ", ".join(f"{text(k)}, {v}" for k, v in entries.items())
    return f"map({pairs})" if pairs else f"CAST(map() AS MAP<STRING, {value_type}>)"


def findings_frame(
    df: DataFrame,
    measures: Measures,
    findings: list[Finding],
    distinct_batch: int = DISTINCT_BATCH,
) -> DataFrame:
    """check_type, column_name, constraint, status, metrics, params - a row per finding."""
    if not findings:
        return df.sparkSession.createDataFrame([], FINDINGS_SCHEMA)
    source = (
        measures.frame(df, distinct_batch) if len(measures) else df.sparkSession.range(1)
    )
    structs = ", ".join(finding.struct() for finding in findings)
    # A lambda keeps Spark from compiling this expression. It is evaluated on one row and,
    # for a wide table, has thousands of parts; compiling would take longer than the scan.
    return source.selectExpr(
        f"inline(filter(array({structs}), f -> f.check_type IS NOT NULL))"
    )


FINDINGS_SCHEMA = (
    "check_type string, column_name string, constraint string, status string, "
    "metrics map<string,double>, params map<string,string>"
)
