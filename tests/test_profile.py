import math
import random

import numpy as np
import pandas as pd
import pandas as pd
import pytest
from conftest import by

from plumbline.operators import duplicates as D
from plumbline.operators import issues as I
from plumbline.operators import profile as P
from plumbline.operators import quantiles
from plumbline.operators import quantiles
from plumbline.operators.quantiles import exact_quantiles


def numbers(spark, **columns):
    names = list(columns)
    rows = [tuple(r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


# ---------------------------------------------------------------- quantiles

PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def check_quantiles(df, columns, max_rows, max_distinct):
    result = exact_quantiles(df, columns, PROBABILITIES, max_rows, max_distinct)
    got = {(r.column_name, r.probability): r.quantile for r in result.collect()}
    pandas = df.select(*columns).toPandas()
    for name in columns:
        values = pandas[name].astype(float)
        values = values[~np.isnan(values)]
        for p in PROBABILITIES:
            assert got[name, p] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("max_rows, max_distinct", [(10**6, 10**4), (40, 10), (1, 0)])
def test_quantiles_equal_brute_force(spark, max_rows, max_distinct):
    draw = random.Random(7)
    n = 3000
    df = numbers(
        spark,
        normal=[draw.gauss(0, 1) for _ in range(n)],
        skewed=[math.exp(draw.gauss(0, 6)) for _ in range(n)],
        few=[float(draw.randrange(5)) for _ in range(n)],
        # a third of all rows hold one value, in the middle of the others
        hot=[0.5 if draw.random() < 0.34 else draw.random() for _ in range(n)],
        gaps=[draw.choice([None, math.nan, draw.random()]) for _ in range(n)],
    )
    check_quantiles(df, df.columns, max_rows, max_distinct)


def test_quantiles_of_integers_and_single_rows(spark):
    df = spark.range(1, 8).selectExpr("CAST(id AS INT) AS i", "-id AS big")
    check_quantiles(df, ["i", "big"], 2, 0)
    check_quantiles(df.limit(1), ["i"], 2, 0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,)).count() == 0


# ---------------------------------------------------------------- describe, profile


def test_describe_equals_pandas(spark):
    draw = random.Random(1)
    df = numbers(
        spark,
        a=[draw.random() * 100 for _ in range(501)],
        b=[None if i % 7 == 0 else float(i) for i in range(501)],
    )
    expected = df.toPandas().describe()
    rows = by(P.describe(df))
    for name in ("a", "b"):
        mine = rows[name]
        values = [mine["count"], mine["mean"], mine["std"], mine["min"]]
        values += [mine["p25"], mine["p50"], mine["p75"], mine["max"]]
        assert values == pytest.approx(expected[name].tolist())


def test_profile_and_card(people):
    rows = by(P.column_profile(people))
    assert rows["name"].asDict() == {
        "column_name": "name",
        "data_type": "string",
        "total_count": 5,
        "null_count": 1,
        "distinct_count": 4,
        "min": None,
        "max": None,
        "mean": None,
        "std": None,
    }
    card = by(P.column_card(people))["age"]
    assert (card.unique_values, card.missing_values) == (5, 0)
    assert (card.min, card.max, card.mean) == (25.0, 45.0, 35.0)


def test_suggestions_and_types(people):
    rows = by(P.suggest_constraints(people))
    assert rows["age"].suggestion == "Column age is numeric - consider range checks"
    assert rows["name"].suggestion == "Column name is string - consider pattern checks"
    assert (rows["age"].observed_min, rows["age"].observed_max) == (25.0, 45.0)
    assert by(P.data_types(people))["id"].data_type == "bigint"
    kinds = by(P.dtype_distribution(people), "data_type")
    assert (kinds["bigint"].column_count, kinds["bigint"].filled_cells) == (3, 15)
    assert (kinds["string"].column_count, kinds["string"].filled_cells) == (1, 4)


# ---------------------------------------------------------------- histogram, top values


def test_histogram(spark):
    df = numbers(
        spark,
        x=[0.0, 1.0, 2.5, 9.9, 10.0, None, math.nan, math.inf, -math.inf],
        flat=[3.0] * 9,
        none=[None] * 9,
    )
    rows = P.histogram(df, bins=4).collect()
    x = sorted((r.bin, r.lower_edge, r.upper_edge, r.value_count) for r in rows if r.column_name == "x")
    assert x == [(0, 0.0, 2.5, 2), (1, 2.5, 5.0, 1), (2, 5.0, 7.5, 0), (3, 7.5, 10.0, 2)]
    flat = [(r.bin, r.lower_edge, r.upper_edge, r.value_count) for r in rows if r.column_name == "flat"]
    assert flat == [(0, 3.0, 3.0, 9)]
    assert not [r for r in rows if r.column_name == "none"]


def test_top_values_rank_ties_by_value(spark):
    df = spark.createDataFrame(
        [(c, i % 2 == 0) for i, c in enumerate("bbaaccdd" + "e")] + [(None, None)],
        "letter string, even boolean",
    )
    rows = P.top_values(df, k=3).collect()
    letters = sorted((r["rank"], r.value, r.value_count) for r in rows if r.column_name == "letter")
    assert letters == [(1, "a", 2), (2, "b", 2), (3, "c", 2)]
    even = sorted((r["rank"], r.value, r.value_count) for r in rows if r.column_name == "even")
    assert even == [(1, "true", 5), (2, "false", 4)]


# ---------------------------------------------------------------- duplicates, issues


@pytest.fixture(params=["10m", "-1"])
def broadcasts(spark, request):
    """With and without broadcast joins."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def test_duplicates(spark, broadcasts):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "x"), (None, "x"), (2, None), (3, "c")]
    df = spark.createDataFrame(rows, "a int, b string")
    assert D.duplicate_rows(df).first().duplicate_rows == 3
    groups = {(r.a, r.b): r.copies for r in D.duplicate_groups(df).collect()}
    assert groups == {(1, "a"): 3, (None, "x"): 2}


def test_no_duplicates(spark):
    # a hash that ignores where the NULL stands would see two equal rows here
    df = spark.createDataFrame([(5, None), (None, 5)], "a int, b int")
    assert D.duplicate_rows(df).first().duplicate_rows == 0
    assert D.duplicate_groups(df).count() == 0
    assert D.duplicate_rows(df.limit(0)).first().duplicate_rows == 0


def test_duplicates_with_nan_zero_and_maps(spark):
    df = spark.createDataFrame(
        [(math.nan, {"a": 1, "b": 2}), (math.nan, {"b": 2, "a": 1}), (0.0, None), (-0.0, None)],
        "x double, m map<string,int>",
    )
    assert D.duplicate_rows(df).first().duplicate_rows == 2


def test_half_the_table_is_one_row(spark):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, -1, id) AS k", "if(id % 2 = 0, 'hot', 'x') AS v")
    assert D.duplicate_rows(df).first().duplicate_rows == 1999


def test_nested_nulls_are_told_apart(spark):
    df = spark.sql(
        "SELECT array(1, NULL) AS a, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS s "
        "UNION ALL SELECT array(NULL, 1), named_struct('x', CAST(NULL AS INT), 'y', 1) "
        "UNION ALL SELECT array(), NULL UNION ALL SELECT NULL, NULL"
    )
    assert D.duplicate_rows(df).first().duplicate_rows == 0
    assert D.duplicate_rows(df.union(df)).first().duplicate_rows == 4


def test_issue_summary(people):
    row = I.issue_summary(people.union(people.limit(1))).first()
    assert (row.total_rows, row.total_columns, row.duplicate_rows) == (6, 4, 1)
    assert [tuple(m) for m in row.missing_values] == [("name", 1, pytest.approx(100 / 6))]
    assert row.numeric_columns == ["id", "age", "salary"]
    assert row.categorical_columns == ["name"]
    assert row.data_types[0].data_type == "bigint"


def test_missing(people):
    assert [tuple(r) for r in I.missing_by_column(people).collect()] == [("name", 1, 20.0)]
    assert I.total_missing(people).first().missing_cells == 1


def test_ties_of_one_start_are_cut_by_whole_values(spark):
    """Only k + 1 keys of a column leave the first ranking, whatever ties there are."""
    start = "https://example.com/" + "x" * 60
    rows = [(f"{start}{i:05d}", "a" if i % 2 else "b") for i in range(3000)]
    rows += [(f"{start}{i:05d}", None) for i in (7, 2999)] + [("short", "a")] * 3
    df = spark.createDataFrame(rows, "u string, t string").repartition(4)
    marked = P.marked_values(df, ["u", "t"])
    assert P.frequent_keys(marked, 6).count() <= 2 * 6
    found = {(r.column_name, r.rank): (r.value, r.value_count) for r in P.top_values(df, ["u", "t"], 5).collect()}
    assert [found["u", i] for i in range(1, 6)] == [
        ("short", 3), (f"{start}00007", 2), (f"{start}02999", 2), (f"{start}00000", 1), (f"{start}00001", 1)
    ]
    assert [found["t", i] for i in (1, 2)] == [("a", 1503), ("b", 1500)] and len(found) == 7


# ---------------------------------------------------------------- scans of describe


def test_describe_of_a_large_table_takes_three_scans(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(1e6, 1.0, 4000), "b": rng.integers(0, 3, 4000) * 1.0}
    spark.createDataFrame(pd.DataFrame(values)).repartition(7).write.parquet(f"{tmp_path}/t")
    calls = []
    for step in ("_survey", "_propose", "_narrow", "_settle"):
        work = getattr(quantiles, step)
        monkeypatch.setattr(
            quantiles, step, lambda *a, work=work, step=step: calls.append(step) or work(*a)
        )
    monkeypatch.setattr(quantiles, "FEW_ROWS", 100)
    result = P.describe(spark.read.parquet(f"{tmp_path}/t"))
    assert calls == ["_survey", "_narrow", "_settle"]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    expected = pd.DataFrame(values).describe()
    for name, row in by(result).items():
        got = [row["count"], row.mean, row.std, row.min, row.p25, row.p50, row.p75, row.max]
        assert got == pytest.approx(expected[name].tolist(), rel=1e-9)


def test_moments_of_partitions_without_values_and_of_infinite_ones(spark):
    df = spark.createDataFrame(
        [(1.0, None, float("inf")), (float("nan"), None, 1.0), (3.0, None, 2.0)],
        "a double, b double, c double",
    ).repartition(5)
    rows = by(P.describe(df))
    assert (rows["a"]["count"], rows["a"].mean, rows["a"].std) == (2, 2.0, pytest.approx(2**0.5))
    assert (rows["b"]["count"], rows["b"].mean, rows["b"].std, rows["b"].p50) == (0, None, None, None)
    assert rows["c"].mean == rows["c"].max == float("inf") and rows["c"].p50 == 2.0
