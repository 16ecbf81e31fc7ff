"""Exact quantiles without gathering a column in one task.

The built-in ``percentile`` merges one value-to-count map of the whole column in a single
task. Here a quantile is found as the order statistics around its position:

1. one scan counts the rows of every column, takes the moments asked for and draws a first
   quantile sketch;
2. while the candidates for a rank are many rows *and* many distinct values, draw a
   quantile sketch of them, put a tight interval around the rank and count exactly what
   lies below, on and between its ends. The counts decide: a rank that fell on an end is
   found, a rank inside narrows further, a rank outside keeps the old interval and tries
   a wider one. The sketch only proposes - it never decides a result;
3. count the remaining candidates per value, add the counts up in value order and read
   off the ranks. By then an interval holds few rows or few distinct values.

Sketches and counts are merged in two levels, first by groups of tasks, so no single
task merges one sketch per input partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import col, normalise, number, quoted
from plumbline.plans.measures import DISTINCT_BATCH as COLUMNS_PER_SCAN

#: A column with at most this many rows is settled without narrowing.
FEW_ROWS = 100_000
#: An interval with at most this many rows, or ...
MAX_ROWS = 2_000_000
#: ... this many distinct values, is settled by counting its values.
MAX_DISTINCT = 10_000
#: First-level merge groups of a narrowing pass.
MERGE_GROUPS = 256
SKETCH_K = 2000
MARGIN = 0.005


@dataclass(frozen=True)
class _Target:
    """One order statistic: the value at ``rank`` (from 0) of ``column``."""

    column: str
    rank: int
    #: open interval known to hold the value, None where unbounded
    low: float | None = None
    high: float | None = None
    #: rows at or below ``low``, rows strictly inside, distinct values inside
    before: int = 0
    inside: int = 0
    distinct: int = 0
    margin: float = MARGIN
    value: float | None = None

    @property
    def interval(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high

    def settled(self, max_rows: int, max_distinct: int) -> bool:
        return (
            self.value is not None
            or self.inside <= max_rows
            or self.distinct <= max_distinct
        )


Interval = tuple[str, float | None, float | None]


def _double(name: str) -> str:
    return f"CAST({quoted(name)} AS DOUBLE)"


def _within(name: str, low: float | None, high: float | None) -> str:
    parts = [f"{quoted(name)} IS NOT NULL"]
    if low is not None:
        parts.append(f"{_double(name)} > {number(low)}")
    if high is not None:
        parts.append(f"{_double(name)} < {number(high)}")
    return f"({' AND '.join(parts)})"


def _candidates(df: DataFrame, intervals: Sequence[Interval]) -> DataFrame:
    """Columns i0, i1, ...: the values inside each interval; rows without any are gone.

    The filter comes before NaN is replaced, on the columns of the source, which can
    then skip row groups. NaN is never inside an interval with an upper end.
    """
    open_ended = any(low is None and high is None for _, low, high in intervals)
    if not open_ended:
        df = df.filter(" OR ".join(dict.fromkeys(_within(*i) for i in intervals)))
    return normalise(df).selectExpr(
        *[
            f"{_double(interval[0])} AS i{i}"
            if interval[1:] == (None, None)
            else f"if({_within(*interval)}, {_double(interval[0])}, NULL) AS i{i}"
            for i, interval in enumerate(intervals)
        ]
    )


def _clusters(targets: Sequence[_Target]) -> list[list[_Target]]:
    """Targets of one interval whose ranks lie close enough to share a proposal."""
    out: list[list[_Target]] = []
    for t in sorted(targets, key=lambda t: (t.column, str(t.interval), t.rank)):
        if out:
            first = out[-1][0]
            near = t.rank - first.rank <= max(2, first.margin * first.inside / 4)
            if first.interval == t.interval and first.margin == t.margin and near:
                out[-1].append(t)
                continue
        out.append([t])
    return out


def _propose(
    df: DataFrame, clusters: Sequence[Sequence[_Target]]
) -> tuple[list[tuple[float, float]], dict[Interval, int]]:
    """A (low, high) around the ranks of each cluster, and about how many distinct values
    each interval holds, from one scan."""
    intervals = list(dict.fromkeys(c[0].interval for c in clusters))
    grouped = (
        _candidates(df, intervals)
        .groupBy(F.expr(f"pmod(spark_partition_id(), {MERGE_GROUPS})").alias("merge"))
        .agg(
            *[
                F.expr(f"{what} AS {alias}{i}")
                for i in range(len(intervals))
                for alias, what in (
                    ("s", f"kll_sketch_agg_double(i{i}, {SKETCH_K})"),
                    # adding 0 makes one zero of two
                    ("d", f"hll_sketch_agg(if(i{i} IS NULL, NULL, xxhash64(i{i} + 0D)))"),
                )
            ]
        )
    )
    merged = grouped.selectExpr(
        *[f"kll_merge_agg_double(s{i}) AS s{i}" for i in range(len(intervals))],
        *[f"hll_union_agg(d{i}) AS d{i}" for i in range(len(intervals))],
    )
    wanted = [f"hll_sketch_estimate(d{i}) AS d{i}" for i in range(len(intervals))]
    for j, cluster in enumerate(clusters):
        first, last = cluster[0], cluster[-1]
        sketch = f"s{intervals.index(first.interval)}"
        for side, at in (
            ("l", (first.rank - first.before) / first.inside - first.margin),
            ("h", (last.rank - last.before) / last.inside + last.margin),
        ):
            at = min(max(at, 0.0), 1.0)
            wanted.append(
                f"kll_sketch_get_quantile_double({sketch}, {number(at)}) AS {side}{j}"
            )
    row = merged.selectExpr(*wanted).first()
    between = [(row[f"l{j}"], row[f"h{j}"]) for j in range(len(clusters))]
    return between, {interval: row[f"d{i}"] for i, interval in enumerate(intervals)}


def _narrow(
    df: DataFrame,
    clusters: Sequence[Sequence[_Target]],
    proposals: Sequence[tuple[float, float]],
) -> list[_Target]:
    """The targets after one counting scan; see step 2 above."""
    intervals = list(dict.fromkeys(c[0].interval for c in clusters))
    aggregates = []
    for j, (cluster, (low, high)) in enumerate(zip(clusters, proposals)):
        x = f"i{intervals.index(cluster[0].interval)}"
        inside = f"{x} > {number(low)} AND {x} < {number(high)}"
        aggregates += [
            f"count_if({x} < {number(low)}) AS below{j}",
            f"count_if({x} = {number(low)}) AS at_low{j}",
            f"count_if({inside}) AS inside{j}",
            f"count_if({x} = {number(high)}) AS at_high{j}",
        ]
    row = _candidates(df, intervals).selectExpr(*aggregates).first()
    out = []
    for j, (cluster, (low, high)) in enumerate(zip(clusters, proposals)):
        below, at_low = row[f"below{j}"], row[f"at_low{j}"]
        inside, at_high = row[f"inside{j}"], row[f"at_high{j}"]
        for t in cluster:
            position = t.rank - t.before - below
            if 0 <= position < at_low:
                out.append(replace(t, value=low))
            elif at_low <= position < at_low + inside:
                out.append(
                    replace(
                        t,
                        low=low,
                        high=high,
                        before=t.before + below + at_low,
                        inside=inside,
                        distinct=inside,
                        margin=MARGIN,
                    )
                )
            elif low < high and 0 <= position - at_low - inside < at_high:
                out.append(replace(t, value=high))
            else:
                out.append(replace(t, margin=t.margin * 2))
    return out


def _settle(df: DataFrame, targets: Sequence[_Target]) -> DataFrame:
    """(column_name, rank, value) of targets whose intervals are small enough.

    Narrowed intervals share one scan. Of whole columns a few at a time do; those scans read
    disjoint columns.
    """
    whole = {t.column for t in targets if t.low is None and t.high is None}
    columns = list(dict.fromkeys(t.column for t in targets))
    narrow = [c for c in columns if c not in whole]
    columns = [c for c in columns if c in whole]
    groups = [columns[i : i + COLUMNS_PER_SCAN] for i in range(0, len(columns), COLUMNS_PER_SCAN)]
    if narrow:
        groups.append(narrow)
    labels: dict[Interval, str] = {}
    counted = []
    for some in groups:
        intervals = list(dict.fromkeys(t.interval for t in targets if t.column in some))
        first = len(labels)
        labels |= {interval: f"{first + i}" for i, interval in enumerate(intervals)}
        counted.append(
            _candidates(df, intervals)
            .withColumnsRenamed({f"i{i}": labels[n] for i, n in enumerate(intervals)})
            .unpivot([], [col(labels[n]) for n in intervals], "interval", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("interval", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
    upto = Window.partitionBy("interval").orderBy("value")
    placed = reduce(DataFrame.unionByName, counted).withColumn(
        "upto", F.sum("rows").over(upto)
    )
    wanted = df.sparkSession.createDataFrame(
        [(labels[t.interval], t.column, t.rank, t.rank - t.before) for t in targets],
        "interval string, column_name string, rank bigint, position bigint",
    )
    # two ranks per column and probability: a handful of rows
    return (
        placed.join(F.broadcast(wanted), "interval")
        .filter("position < upto AND position >= upto - rows")
        .select("column_name", "rank", "value")
    )


@dataclass(frozen=True)
class Moments:
    """What the first scan tells of a column; NULL and NaN are left out."""

    count: int
    mean: float | None
    std: float | None
    min: float | None
    max: float | None


def _merged_squares(i: int) -> str:
    """Squared deviations from the mean, added up over groups of tasks."""
    return (
        f"aggregate(collect_list(struct(n{i} AS n, a{i} AS a, q{i} AS q)), "
        "struct(CAST(0 AS BIGINT) AS n, 0D AS a, 0D AS q), (x, y) -> if(y.n = 0, x, struct("
        "x.n + y.n AS n, x.a + (y.a - x.a) * y.n / (x.n + y.n) AS a, "
        "x.q + y.q + (y.a - x.a) * (y.a - x.a) * x.n * y.n / (x.n + y.n) AS q)), x -> x.q)"
    )


def _survey(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float]
) -> tuple[list[Moments], dict[tuple[int, int], tuple[float, float]]]:
    """Moments of every column, and an interval per column and probability, in one scan.

    Tasks combine their rows first, then up to ``MERGE_GROUPS`` groups of them; the last
    step merges one row per group.
    """
    columns = range(len(names))
    first = (
        normalise(df)
        .selectExpr(*[f"{_double(n)} AS x{i}" for i, n in enumerate(names)])
        .groupBy(F.expr(f"pmod(spark_partition_id(), {MERGE_GROUPS})").alias("merge"))
        .agg(
            *[
                F.expr(f"{what} AS {alias}{i}")
                for i in columns
                for alias, what in (
                    ("n", f"count(x{i})"),
                    ("a", f"avg(x{i})"),
                    ("q", f"var_pop(x{i}) * count(x{i})"),
                    ("lo", f"min(x{i})"),
                    ("hi", f"max(x{i})"),
                    ("s", f"kll_sketch_agg_double(x{i}, {SKETCH_K})"),
                )
            ]
        )
    )
    merged = first.selectExpr(
        *[
            f"{what} AS {alias}{i}"
            for i in columns
            for alias, what in (
                ("n", f"coalesce(sum(n{i}), 0)"),
                ("t", f"sum(a{i} * n{i})"),
                ("q", _merged_squares(i)),
                ("lo", f"min(lo{i})"),
                ("hi", f"max(hi{i})"),
                ("s", f"kll_merge_agg_double(s{i})"),
            )
        ]
    )
    sides = [
        (i, j, alias, min(max(p + margin, 0.0), 1.0))
        for i in columns
        for j, p in enumerate(probabilities)
        for alias, margin in (("l", -MARGIN), ("h", MARGIN))
    ]
    row = merged.selectExpr(
        *[f"n{i}" for i in columns],
        *[f"lo{i}" for i in columns],
        *[f"hi{i}" for i in columns],
        *[f"if(n{i} > 0, t{i} / n{i}, NULL) AS mean{i}" for i in columns],
        *[f"if(n{i} > 1, sqrt(q{i} / (n{i} - 1)), NULL) AS std{i}" for i in columns],
        *[
            f"if(n{i} > 0, kll_sketch_get_quantile_double(s{i}, {number(at)}), NULL) "
            f"AS {alias}{i}_{j}"
            for i, j, alias, at in sides
        ],
    ).first()
    moments = [
        Moments(*[row[f"{what}{i}"] for what in ("n", "mean", "std", "lo", "hi")])
        for i in columns
    ]
    between = {
        (i, j): (row[f"l{i}_{j}"], row[f"h{i}_{j}"])
        for i in columns
        for j in range(len(probabilities))
    }
    return moments, between


def exact_quantiles(
    df: DataFrame,
    columns: Iterable[str],
    probabilities: Sequence[float],
    max_rows: int = MAX_ROWS,
    max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """column_name, probability, quantile; linear interpolation, NULL and NaN left out.

    A column without values gets no rows; see ``moments_and_quantiles``.
    """
    return moments_and_quantiles(df, columns, probabilities, max_rows, max_distinct)[1]


def moments_and_quantiles(
    df: DataFrame,
    columns: Iterable[str],
    probabilities: Sequence[float],
    max_rows: int = MAX_ROWS,
    max_distinct: int = MAX_DISTINCT,
) -> tuple[dict[str, Moments], DataFrame]:
    """The moments of each column, and the frame of ``exact_quantiles``.

    One scan for moments and sketches, one that counts around the ranks, one for the result;
    a small table needs no second one. Where an interval still holds many rows (a pass keeps
    about one in a hundred), each further pass adds two scans.
    """
    spark, names = df.sparkSession, list(columns)
    schema = "column_name string, probability double, quantile double"
    if not names:
        return {}, spark.createDataFrame([], schema)
    moments, between = _survey(df, names, probabilities)

    targets: dict[tuple[str, int], _Target] = {}
    parts: list[tuple[str, float, int, int, float]] = []
    clusters: list[list[_Target]] = []
    proposals: list[tuple[float, float]] = []
    for i, name in enumerate(names):
        rows = moments[i].count
        if rows == 0:
            continue
        for j, p in enumerate(probabilities):
            position = p * (rows - 1)
            lower = math.floor(position)
            upper = min(lower + 1, rows - 1)
            parts.append((name, float(p), lower, upper, position - lower))
            fresh = [rank for rank in dict.fromkeys((lower, upper)) if (name, rank) not in targets]
            for rank in fresh:
                # how many values are distinct is not known before a sketch of them
                targets[name, rank] = _Target(name, rank, inside=rows, distinct=rows)
            if fresh and rows > min(max_rows, FEW_ROWS):
                clusters.append([targets[name, rank] for rank in fresh])
                proposals.append(between[i, j])
    known = dict(zip(names, moments))
    if not parts:
        return known, spark.createDataFrame([], schema)

    if clusters:
        for t in _narrow(df, clusters, proposals):
            targets[t.column, t.rank] = t
    while pending := [
        t for t in targets.values() if not t.settled(max_rows, max_distinct)
    ]:
        clusters = _clusters(pending)
        proposals, distinct = _propose(df, clusters)
        open_ones = []
        for cluster, proposal in zip(clusters, proposals):
            found = distinct[cluster[0].interval]
            if found > max_distinct:
                open_ones.append((cluster, proposal))
                continue
            for t in cluster:
                targets[t.column, t.rank] = replace(t, distinct=found)
        if open_ones:
            for t in _narrow(df, *zip(*open_ones)):
                targets[t.column, t.rank] = t

    found = [(t.column, t.rank, t.value) for t in targets.values() if t.value is not None]
    open_targets = [t for t in targets.values() if t.value is None]
    values = spark.createDataFrame(
        found, "column_name string, rank bigint, value double"
    )
    if open_targets:
        settled = _settle(df, open_targets)
        values = values.unionByName(settled) if found else settled
    wanted = spark.createDataFrame(
        parts,
        "column_name string, probability double, lower bigint, upper bigint, "
        "fraction double",
    )
    quantiles = (
        values.join(F.broadcast(wanted), "column_name")
        .groupBy("column_name", "probability")
        .agg(
            F.max(F.when(F.col("rank") == F.col("lower"), F.col("value"))).alias("a"),
            F.max(F.when(F.col("rank") == F.col("upper"), F.col("value"))).alias("b"),
            F.max("fraction").alias("fraction"),
        )
        .select(
            "column_name",
            "probability",
            # a rank met exactly and equal neighbours need no interpolation (infinities allow none)
            F.when((F.col("a") == F.col("b")) | (F.col("fraction") == 0), F.col("a"))
            .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("fraction"))
            .alias("quantile"),
        )
    )
    return known, quantiles
