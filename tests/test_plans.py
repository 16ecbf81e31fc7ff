"""What the plans look like: scans, pruning, pushdown, no cross joins, no Python."""

import re

import pytest

from plumbline.catalog import QUERIES
from plumbline.catalog.views import customer_f, runs_f
from plumbline.operators import anomalies as Z
from plumbline.operators import checks as C
from plumbline.operators import duplicates as D
from plumbline.operators import profile as P
from plumbline.operators import runs as R
from plumbline.operators import suite as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text) -> list[str]:
    return re.findall(r"FileScan.*", text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_joins(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for word in ("CartesianProduct", "NestedLoop", "Python", "MapInPandas"):
        assert word not in text


def test_one_scan_for_all_plain_checks(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert len(scans(plan(C.completeness(lineitem)))) == 1
    # the suite: one fused scan, and one per four columns counted exactly
    assert len(scans(plan(S.run_suite(lineitem)))) == 1 + 3


def test_a_wide_suite_reads_each_column_once_per_kind_of_scan(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    wide = lineitem.selectExpr("*", *[f"{c} AS {c}_2" for c in lineitem.columns])
    for error, expected in ((0.05, 1), (None, 2)):
        text = plan(S.run_suite(wide.drop("l_tax_2"), approx_distinct_error=error))
        read = [
            field.split(":")[0]
            for schema in re.findall(r"ReadSchema: struct<(.*?)>", text)
            for field in schema.split(",")
        ]
        # l_tax has no second name here, so nothing but its own check reads it
        assert read.count("l_tax") == expected


def test_only_the_columns_asked_for_are_read(spark, folder):
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(C.completeness(lineitem, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text
    text = plan(C.uniqueness(lineitem, ["l_orderkey", "l_tax"], distinct_batch=1))
    schemas = sorted(re.findall(r"ReadSchema: struct<(.*?)>", text))
    assert schemas == ["", "l_orderkey:bigint", "l_tax:double"]


def test_unused_checks_are_not_computed(spark, folder):
    results = S.run_suite(customer_f(spark, folder))
    assert "Expand" in plan(results)
    text = plan(C.completeness(customer_f(spark, folder)))
    assert "Expand" not in text and "stddev" not in text


def test_anomaly_bounds_reach_the_scan(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    text = plan(Z.anomaly_rows(events, Z.fit_bands(events, ["value"]), ["event_id"]))
    assert "PushedFilters: [Or(LessThan(value" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_latest_runs_are_limited_before_the_shuffle(spark, folder):
    text = plan(R.recent_runs(runs_f(spark, folder), 5))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_top_values_are_limited_before_the_last_shuffle(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    text = plan(P.frequent_keys(P.marked_values(documents, ["text", "lang"]), 10))
    # no whole text is shuffled
    for keys in re.findall(r"hashpartitioning\((.*?)\), ENSURE", text):
        assert "value#" not in keys
    partial = text.index("Partial")
    assert text.index("Final") < text.index("Exchange") < partial
    # values are counted map-side, below their own shuffle
    assert text.index("Exchange", partial) < text.rindex("partial_count")


def test_duplicates_shuffle_fingerprints_not_rows(spark, folder):
    text = plan(D.duplicate_rows(spark.read.parquet(f"{folder}/lineitem.parquet")))
    # one scan, and nothing but the fingerprint (two hashes of all columns) is a key
    assert text.count("FileScan") == 1
    keys = re.findall(r"hashpartitioning\((.*?), \d+\), ENSURE", text)
    assert len(keys) == 1 and "l_" not in keys[0]


def test_last_runs_need_no_full_sort(spark, folder):
    text = plan(R.run_history(runs_f(spark, folder), limit=10))
    assert "TakeOrderedAndProject" in text


def test_filters_on_runs_are_pushed(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    runs = orders.selectExpr("o_orderstatus AS dataset_name", "o_totalprice AS quality_score")
    text = plan(R.dataset_names(runs.filter("dataset_name = 'F'")))
    assert "EqualTo(o_orderstatus,F)" in text
