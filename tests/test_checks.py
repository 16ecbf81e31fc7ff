import datetime
import math

import pytest
from conftest import by
from pyspark.sql import functions as F

from plumbline.operators import checks as C
from plumbline.operators import suite as S


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def score(results):
    return S.quality_score(results).first()["quality_score"]


# ---------------------------------------------------------------- golden frames


def test_five_people_with_and_without_text(people):
    assert score(S.run_suite(people)) == 75.0
    without = S.run_suite(people, text=False)
    assert round(score(without), 2) == 81.82


def test_sales_frame(spark):
    rows = [
        (
            i,
            i % 20 + 1,
            i % 10 + 1,
            10.0 + i * 7.77,
            str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i)),
        )
        for i in range(100)
    ]
    sales = spark.createDataFrame(
        rows,
        "order_id bigint, customer_id bigint, product_id bigint, amount double, "
        "order_date string",
    )
    result = S.quality_score(S.run_suite(sales)).first()
    assert (result.total_checks, result.passed_checks) == (15, 13)
    assert round(result.quality_score, 2) == 86.67


def test_check_type_summary(people):
    summary = by(S.check_type_summary(S.run_suite(people)), "check_type")
    assert summary["Completeness"].success_rate == "75.0%"
    assert summary["Text Quality"].failed == 1
    assert "Data Profile" not in summary


# ---------------------------------------------------------------- thresholds


@pytest.mark.parametrize("missing, status", [(5, "Success"), (6, "Failure")])
def test_completeness_edge(spark, missing, status):
    df = column(spark, [None] * missing + [1] * (100 - missing), "int")
    row = C.completeness(df).first()
    assert (row.status, row.null_count, row.total_count) == (status, missing, 100)
    assert row.completeness_ratio == (100 - missing) / 100


@pytest.mark.parametrize("distinct, status", [(90, "Success"), (89, "Failure")])
def test_uniqueness_edge(spark, distinct, status):
    df = column(spark, [min(i, distinct - 1) for i in range(100)], "int")
    row = C.uniqueness(df).first()
    assert (row.status, row.distinct_count) == (status, distinct)


def test_uniqueness_does_not_count_null(spark):
    row = C.uniqueness(column(spark, [1, 2, None, None], "int")).first()
    assert (row.distinct_count, row.uniqueness_ratio) == (2, 0.5)


def test_uniqueness_of_nested_columns(spark):
    df = spark.createDataFrame(
        [([1], {"a": 1, "b": 2}), ([1], {"b": 2, "a": 1}), ([2], None)],
        "xs array<int>, m map<string,int>",
    )
    rows = by(C.uniqueness(df))
    assert rows["xs"].distinct_count == 2
    assert rows["m"].distinct_count == 1


def test_approximate_uniqueness_is_close(spark):
    df = spark.range(20000).withColumn("k", F.col("id") % 5000)
    rows = by(C.uniqueness(df, approx_distinct_error=0.02))
    assert abs(rows["id"].distinct_count - 20000) < 20000 * 0.08
    assert abs(rows["k"].distinct_count - 5000) < 5000 * 0.08


@pytest.mark.parametrize("batch", [1, 2, 3, 50])
def test_distinct_batches_agree(spark, batch):
    df = spark.range(300).selectExpr(
        *[f"id % {n} AS c{n}" for n in (2, 3, 5, 7, 11)]
    )
    rows = by(C.uniqueness(df, distinct_batch=batch))
    assert {n: rows[f"c{n}"].distinct_count for n in (2, 3, 5, 7, 11)} == {
        2: 2, 3: 3, 5: 5, 7: 7, 11: 11,
    }


@pytest.mark.parametrize(
    "values, negative, huge, status",
    [
        ([0.0, 1e10, None], 0, 0, "Success"),
        ([-0.5, 1.0], 1, 0, "Failure"),
        ([1.0, 1.1e10], 0, 1, "Failure"),
        ([math.nan, 1.0], 0, 0, "Success"),
    ],
)
def test_consistency(spark, values, negative, huge, status):
    row = C.consistency(column(spark, values, "double")).first()
    assert (row.negative_count, row.outlier_count, row.status) == (
        negative, huge, status,
    )


def test_consistency_covers_every_numeric_type(spark):
    df = spark.sql(
        "SELECT CAST(1 AS TINYINT) a, CAST(1 AS SMALLINT) b, 1 c, 1L d, CAST(1 AS FLOAT) e,"
        " 1D f, CAST(-1 AS DECIMAL(10,2)) g, true h, 'x' i"
    )
    rows = by(C.consistency(df))
    assert sorted(rows) == list("abcdefg")
    assert rows["g"].negative_count == 1


@pytest.mark.parametrize(
    "bounds, violations",
    [
        ({"min": 3}, 2),
        ({"max": 3}, 2),
        ({"min": 2, "max": 4}, 2),
        ({"min": 4, "max": 2}, 5 + 1 - 1),
        ({}, 0),
        ({"min": None, "max": 4.5}, 1),
    ],
)
def test_range(spark, bounds, violations):
    df = column(spark, [1, 2, 3, 4, 5, None], "int")
    if bounds == {"min": 4, "max": 2}:
        # 1, 2, 3 are below 4; 3, 4, 5 are above 2: the 3 counts twice
        violations = 6
    row = C.range_check(df, {"c": bounds}).first()
    assert row.violations == violations
    assert row.violation_ratio == violations / 6


def test_range_on_dates_and_big_integers(spark):
    df = spark.sql(
        "SELECT DATE'2024-01-01' d, TIMESTAMP_NTZ'2024-01-01 10:00:00' t, "
        "9007199254740993L b"
    )
    rows = by(
        C.range_check(
            df,
            {
                "d": {"min": datetime.date(2024, 1, 2)},
                "t": {"max": datetime.datetime(2024, 1, 1, 9)},
                "b": {"max": 9007199254740992},
            },
        )
    )
    assert {name: row.violations for name, row in rows.items()} == {
        "d": 1, "t": 1, "b": 1,
    }


def test_pattern_really_matches(spark):
    df = column(spark, ["a1", "b22", "zz", None], "string")
    row = C.pattern_check(df, {"c": r"^[a-z]\d+$"}).first()
    assert (row.violations, row.status, row.pattern) == (1, "Failure", r"^[a-z]\d+$")


@pytest.mark.parametrize(
    "pattern, value",
    [
        (r"^\\$", "\\"),
        ("^it's$", "it's"),
        (r"^\$\{x\}$", "${x}"),
        ("[$]{1}", "$"),
        ("^a${1}", "a"),
        ('^"q"\n$', '"q"\n'),
        (r"^\t\d{2,}$", "\t12"),
    ],
)
def test_patterns_reach_spark_unchanged(spark, pattern, value):
    row = C.pattern_check(column(spark, [value], "string"), {"c": pattern}).first()
    assert (row.violations, row.pattern) == (0, pattern)


@pytest.mark.parametrize(
    "values, counts, status",
    [
        (["x" * 10] * 10, (0, 0, 0, 0), "Success"),
        (["x" * 9] * 3 + ["x" * 10] * 7, (0, 0, 3, 0), "Success"),
        (["x" * 9] * 4 + ["x" * 10] * 6, (0, 0, 4, 0), "Failure"),
        (["x" * 1000] * 10, (0, 0, 0, 0), "Success"),
        (["x" * 1001] + ["x" * 10] * 9, (0, 0, 0, 1), "Success"),
        (["x" * 1001] * 2 + ["x" * 10] * 8, (0, 0, 0, 2), "Failure"),
        ([None] + ["x" * 10] * 9, (1, 0, 0, 0), "Success"),
        ([None] * 2 + ["x" * 10] * 8, (2, 0, 0, 0), "Failure"),
        ([""] + ["x" * 10] * 19, (0, 1, 1, 0), "Success"),
        ([""] + ["x" * 10] * 18, (0, 1, 1, 0), "Failure"),
        # characters count, not bytes: of two, three and four bytes each
        (["é" * 9, "é" * 10, "漢" * 9, "漢" * 10, "😀" * 9, "😀" * 10], (0, 0, 3, 0), "Failure"),
        (["é" * 1000, "漢" * 1000, "😀" * 1000], (0, 0, 0, 0), "Success"),
        (["é" * 1001, "漢" * 1001, "😀" * 1001, "x" * 4001], (0, 0, 0, 4), "Failure"),
    ],
)
def test_text_quality(spark, values, counts, status):
    row = C.text_quality(column(spark, values, "string")).first()
    found = (row.null_count, row.empty_count, row.short_count, row.long_count)
    assert (found, row.status) == (counts, status)


@pytest.mark.parametrize(
    "address, bad",
    [
        ("a.b+c@x-y.co", 0),
        ("a@b.c", 1),
        ("invalid-email", 1),
        ("a b@c.de", 1),
        ("@c.de", 1),
        (None, 1),
    ],
)
def test_email_format(spark, address, bad):
    row = C.email_format(column(spark, [address], "string"), "c").first()
    assert row.violations == bad


@pytest.mark.parametrize(
    "subject, spam",
    [
        ("urgent: read", 1),
        ("Buy Now", 1),
        ("wow!!!", 1),
        ("limited time", 1),
        ("act fast", 1),
        ("Meeting!!", 0),
        (None, 0),
    ],
)
def test_spam(spark, subject, spam):
    assert C.spam_indicator(column(spark, [subject], "string"), "c").first().violations == spam


def test_sentiment(spark):
    df = column(spark, [-1.0, 1.0, 1.01, -1.01, None, math.nan], "double")
    row = C.sentiment_validity(df, "c").first()
    assert (row.violations, row.total_count) == (2, 6)


@pytest.mark.parametrize("bad, status", [(4, "Success"), (5, "Failure")])
def test_email_threshold_is_strict(spark, bad, status):
    df = column(spark, ["x"] * bad + ["a@b.cd"] * (100 - bad), "string")
    assert C.email_format(df, "c").first().status == status


# ---------------------------------------------------------------- odd inputs


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, subject string")
    results = S.run_suite(df).filter("status IS NOT NULL")
    status = {(r.check_type, r.column_name): r.status for r in results.collect()}
    assert status["completeness", "a"] == "Failure"
    assert status["uniqueness", "a"] == "Failure"
    assert status["consistency", "a"] == "Success"
    assert status["text_quality", "subject"] == "Success"
    assert status["email_specific", "subject"] == "Success"


def test_nan_is_missing(spark):
    row = C.completeness(column(spark, [math.nan, None, 1.0], "double")).first()
    assert row.null_count == 2
    row = C.uniqueness(column(spark, [math.nan, None, 1.0], "double")).first()
    assert row.distinct_count == 1


def test_awkward_column_names(spark):
    names = ["a.b", "two words", "back`tick", "it's", "ünï"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5), (1, 2, 3, None, 5)], names)
    rows = by(C.completeness(df))
    assert set(rows) == set(names)
    assert rows["it's"].null_count == 1
    assert by(S.run_suite(df).filter("check_type = 'data_profile'")).keys() == set(names)


def test_one_bad_check_does_not_stop_the_others(people):
    results = S.run_suite(
        people,
        ranges={"nowhere": {"min": 1}, "age": {"min": "low"}, "salary": {"min": 0}},
        patterns={"age": "x", "name": "(", "missing": "x"},
    )
    rows = results.filter("check_type IN ('range_check', 'pattern_check')").collect()
    status = {r.column_name + "/" + r.check_type: r.status for r in rows}
    assert status == {
        "nowhere/range_check": "Error",
        "age/range_check": "Error",
        "salary/range_check": "Success",
        "age/pattern_check": "Error",
        "name/pattern_check": "Error",
        "missing/pattern_check": "Error",
    }
    # 9 of 12 as without them, and the one range check that ran
    assert S.quality_score(results).first().total_checks == 13
    assert S.failed_to_run(results).count() == 5


def test_mail_checks_only_for_columns_that_exist(spark):
    df = spark.createDataFrame([("a@b.cd", 0.5)], "sender_email string, x double")
    assert [r.constraint for r in C.mail_checks(df).collect()] == [
        "Email format validity"
    ]
    # the suite looks for mail by address, subject or content, not by sentiment
    df = spark.createDataFrame([(0.5,)], "sentiment_score double")
    assert S.run_suite(df).filter("check_type = 'email_specific'").count() == 0


def test_more_columns_than_one_aggregate_takes(spark):
    df = spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(150)])
    results = S.run_suite(df, approx_distinct_error=0.05, profile=False)
    rows = results.filter("check_type = 'completeness'").collect()
    assert len(rows) == 150
    assert {r.metrics["total_count"] for r in rows} == {10.0}


def test_columns_that_cannot_be_compared(spark):
    df = spark.sql("SELECT array(map('a', 1)) AS x, parse_json('1') AS v, 1 AS y")
    results = S.run_suite(df)
    status = {
        r.column_name: r.status
        for r in results.filter("check_type = 'uniqueness'").collect()
    }
    assert status == {"x": "Error", "v": "Error", "y": "Success"}
    profile = by(results.filter("check_type = 'data_profile'"))
    assert "distinct_count" not in profile["v"].metrics
    assert profile["x"].metrics["null_count"] == 0


def test_long_texts_are_counted_whole(spark):
    # equal for a thousand characters, and a text that spells out another's digest
    digest = "#" + __import__("hashlib").sha256(("x" * 1000).encode()).hexdigest()
    texts = ["x" * 1000, "x" * 1000 + "a", "x" * 1000 + "b", "x" * 1000, digest, digest[1:]]
    row = C.uniqueness(column(spark, texts, "string")).first()
    assert row.distinct_count == 5
