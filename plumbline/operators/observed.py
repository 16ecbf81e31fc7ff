"""Measures taken while a table is being written, without a scan of their own.

``Dataset.observe`` lets a query count on the side: the rows pass through the same tasks that
write them, and the partial counts travel with the tasks' results. A pipeline that writes a
table anyway gets its plain measures for nothing. Exact distinct counts need a shuffle and
are left to the checks.

A task that is repeated after a lost executor counts once: Spark takes the counts of the
attempt whose output it commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions import is_numeric, is_text, quoted

MEASURES = (
    "column_name string, total_count bigint, null_count bigint, completeness double, "
    "min double, max double, mean double, std double, empty_count bigint"
)


class Watched:
    """A table whose measures are taken by whatever action runs over it first.

    ``rows`` is the table to write; ``measures()`` waits for that action and returns one
    row per column. NULL and NaN are missing, as everywhere; numbers have their smallest,
    largest, mean and sample deviation, texts the number of empty ones.
    """

    def __init__(self, df: DataFrame) -> None:
        self.spark, self._seen = df.sparkSession, Observation()
        self._fields = list(df.schema.fields)
        taken = [F.expr("count(1)").alias("rows")]
        for i, field in enumerate(self._fields):
            cell = quoted(field.name)
            if field.dataType.typeName() in ("float", "double"):
                cell = f"nanvl({cell}, NULL)"
            taken.append(F.expr(f"count({cell})").alias(f"n{i}"))
            if is_numeric(field.dataType):
                for name in ("min", "max", "avg", "stddev_samp"):
                    taken.append(F.expr(f"{name}(CAST({cell} AS DOUBLE))").alias(f"{name}{i}"))
            if is_text(field.dataType):
                taken.append(F.expr(f"count_if({cell} = '')").alias(f"empty{i}"))
        self.rows = df.observe(self._seen, *taken)

    def measures(self) -> DataFrame:
        seen = self._seen.get
        total = seen["rows"]
        rows = []
        for i, field in enumerate(self._fields):
            present = seen[f"n{i}"]
            rows.append((
                field.name, total, total - present, present / total if total else 0.0,
                *[seen.get(f"{name}{i}") for name in ("min", "max", "avg", "stddev_samp")],
                seen.get(f"empty{i}"),
            ))
        return self.spark.createDataFrame(rows, MEASURES)


def written_and_measured(df: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Runs ``write`` on the rows of ``df`` and returns the measures taken on the way."""
    watched = Watched(df)
    write(watched.rows)
    return watched.measures()
