"""A set of aggregates over one table, computed together.

Every check asks for the numbers it needs (``rows``, ``count_if``, ``stat``,
``distinct``) and gets back SQL text for the finished number, a double. Equal requests
share one aggregate. ``frame`` then turns the whole set into a single one-row DataFrame:

* all non-distinct aggregates run in one ``agg`` - one scan, combined map-side, with one
  short row per task in the shuffle. A very wide table takes several scans, each of its
  own columns, so that every one of them stays within what Spark compiles;
* exact distinct counts run apart, a few columns at a time. Spark expands each input row
  once per distinct column, every copy as wide as all of them, so the work grows with the
  square of the number of columns put together. Small batches read disjoint columns, so
  on a columnar source no byte is read twice, and they run side by side in one job. The
  values are grouped map-side and shuffled by value: a value that fills a third of the
  table leaves each task once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame

#: Name of the column that holds the finished numbers.
RESULT = "measured"
#: Exact distinct counts per scan; measured best among 1, 2, 4, 6, 8 and 11.
DISTINCT_BATCH = 4
#: Aggregation state of one scan. Spark compiles stages of up to 100 fields
#: (spark.sql.codegen.maxFields) and interprets wider ones.
MAX_FIELDS = 90


def _fields(aggregate: str) -> int:
    """Fields of state an aggregate keeps; sketches are interpreted anyhow."""
    if aggregate.startswith("approx_count_distinct"):
        return 1
    return {"avg": 2, "std": 3}.get(aggregate[:3], 1)


class Measures:
    def __init__(self, approx_distinct_error: float | None = None) -> None:
        self._alias: dict[tuple[str | None, str], str] = {}
        self._plain: dict[str | None, dict[str, str]] = {}
        self._distinct: dict[str, str] = {}
        self._error = approx_distinct_error

    def rows(self) -> str:
        return self.stat(None, "count(*)")

    def count_if(self, column: str | None, condition: str) -> str:
        return self.stat(column, f"count_if({condition})")

    def stat(self, column: str | None, aggregate: str) -> str:
        """Register an aggregate that reads ``column``, unless it is there already."""
        return self._register(
            column, aggregate, self._plain.setdefault(column, {})
        )

    def distinct(self, column: str, values: str) -> str:
        """Distinct non-null values: exact, or approximate when an error was given."""
        if self._error is not None:
            return self.stat(column, f"approx_count_distinct({values}, {self._error})")
        return self._register(column, f"count(DISTINCT {values})", self._distinct)

    def _register(self, column: str | None, aggregate: str, group: dict) -> str:
        key = (column, aggregate)
        if key not in self._alias:
            self._alias[key] = f"m{len(self._alias)}"
            group[self._alias[key]] = aggregate
        return f"{RESULT}['{self._alias[key]}']"

    def __len__(self) -> int:
        return len(self._alias)

    def _groups(self, distinct_batch: int) -> Iterator[dict[str, str]]:
        """The aggregates of each scan."""
        group, size = dict(self._plain.get(None, {})), 0
        for column, wanted in self._plain.items():
            if column is None:
                continue
            cost = sum(_fields(aggregate) for aggregate in wanted.values())
            if size and size + cost > MAX_FIELDS:
                yield group
                group, size = {}, 0
            group, size = group | wanted, size + cost
        if group:
            yield group
        pending = list(self._distinct.items())
        for start in range(0, len(pending), distinct_batch):
            yield dict(pending[start : start + distinct_batch])

    def frame(self, df: DataFrame, distinct_batch: int = DISTINCT_BATCH) -> DataFrame:
        """One row with one column: a map from a measure's alias to its value."""
        parts = []
        for group in self._groups(distinct_batch):
            entries = ", ".join(
                f"'{alias}', CAST({aggregate} AS DOUBLE)"
                for alias, aggregate in group.items()
            )
            parts.append(df.selectExpr(f"map({entries}) AS {RESULT}"))
        if len(parts) == 1:
            return parts[0]
        return reduce(DataFrame.union, parts).selectExpr(
            f"map_from_entries(flatten(collect_list(map_entries({RESULT})))) AS {RESULT}"
        )
