import datetime
import json

import pytest
from conftest import by
from pyspark.sql import functions as F

from plumbline.engine import AlertCenter, QualityEngine
from plumbline.operators import runs as R
from plumbline.sources import RunStore, from_pandas, read_table
from plumbline.sources.store import ALERTS, RUNS

DAY = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def engine(spark, tmp_path):
    return QualityEngine(spark, str(tmp_path / "store"))


def history(spark):
    rows = [
        (f"r{i:02d}", "a" if i % 3 else "b", DAY + datetime.timedelta(hours=i), float(i), 10, 2, None, "completed")
        for i in range(20)
    ]
    return spark.createDataFrame(rows, RUNS)


def test_empty_store(engine):
    assert engine.get_run_history().count() == 0
    assert engine.get_run_metrics("x").count() == 0
    assert engine.get_dataset_summary("x").count() == 0
    assert engine.store.alerts().count() == 0
    assert engine.store.metrics_document("x").count() == 0


def test_save_list_summarise_export(engine, people, tmp_path):
    first = engine.run_comprehensive_quality_check(people, dataset_name="Sales Data", timestamp=DAY)
    second = engine.run_comprehensive_quality_check(
        people, dataset_name="Sales Data", timestamp=DAY + datetime.timedelta(days=1), text=False
    )
    other = engine.run_comprehensive_quality_check(people, dataset_name="a/b=c", timestamp=DAY)
    assert first.quality_score == 75.0
    assert [r.run_id for r in engine.get_run_history("Sales Data").collect()] == [
        first.run_id, second.run_id,
    ]
    assert [r.run_id for r in engine.get_run_history("a/b=c").collect()] == [other.run_id]
    assert engine.get_run_history(limit=1).first().run_id == second.run_id
    record = engine.get_run_history("Sales Data").first()
    assert (record.rows, record["columns"], record.status) == (5, 4, "completed")

    summary = engine.get_dataset_summary("Sales Data").first()
    assert summary.total_runs == 2
    assert (summary.score_min, round(summary.score_max, 2)) == (75.0, 81.82)
    assert summary.score_std == pytest.approx((summary.score_max - 75.0) / 2)

    out = str(tmp_path / "export")
    engine.download_metrics_json(first.run_id, out)
    document = json.loads(engine.spark.read.text(out).first().value)
    assert document["run_id"] == first.run_id
    assert document["dataset_name"] == "Sales Data"
    assert document["metrics"]["overall_quality_score"] == 75.0
    assert document["metrics"]["dataset_info"] == {"rows": 5, "columns": 4}
    checks = document["metrics"]["quality_checks"]
    name = [c for c in checks if c["constraint"] == "Completeness of name"][0]
    assert name["metrics"] == {"completeness_ratio": 0.8, "null_count": 1.0, "total_count": 5.0}


def test_without_saving(engine, people):
    run = engine.run_comprehensive_quality_check(people, save_metrics=False)
    assert run.run_id is None
    assert engine.calculate_quality_score(run.results).first().quality_score == 75.0
    assert engine.get_run_history().count() == 0


def test_writing_a_run_again_replaces_it(spark, people, tmp_path):
    store = RunStore(spark, str(tmp_path))
    results = QualityEngine(spark, str(tmp_path)).run_comprehensive_quality_check(
        people, save_metrics=False
    ).results
    for rows in (results, results, results.limit(3)):
        store.save_results(rows, "d", "run-1", DAY)
    store.save_results(results.limit(2), "d", "run-2", DAY)
    assert store.run_metrics("run-1").count() == 3
    assert store.read("check_results").count() == 5


def folders_read(df):
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def test_a_fresh_run_is_read_alone(spark, people, tmp_path):
    store = RunStore(spark, str(tmp_path))
    for i in range(3):
        store.write("runs", history(spark).limit(1), "d", f"run-{i}")
    assert len(folders_read(store.of_run("runs", "run-1"))) == 1
    assert [r.run_id for r in store.of_run("runs", "run-1").collect()] == ["run-1"]


def long_history(spark, n, score="double(id)"):
    """Runs of seven datasets, one every ten hours."""
    return spark.range(n).selectExpr(
        "concat('r', id) AS run_id", "concat('d/=', id % 7) AS dataset_name",
        "timestamp_seconds(1700000000 + id * 36000) AS timestamp", f"{score} AS quality_score",
        "id AS rows", "3 AS columns", "CAST(NULL AS STRING) AS metrics_file", "'completed' AS status",
    )


def data_files(path):
    return [f for f in path.rglob("*.parquet")]


def test_ten_thousand_runs_take_few_files(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.replace_runs("runs", long_history(spark, 10_000))
    months = long_history(spark, 10_000).selectExpr("date_format(timestamp, 'yyyy-MM')").distinct().count()
    assert store.runs().count() == 10_000
    # a file per dataset and month, some cut by a task's border, and the index
    assert len(data_files(tmp_path / "runs")) <= 7 * months + 16
    assert len(data_files(tmp_path)) <= 7 * months + 16 + 16 + 16
    found = store.of_run("runs", "r4711")
    assert [r.rows for r in found.collect()] == [4711]
    assert len(folders_read(found)) == 1
    assert store.of_run("runs", "nobody").count() == 0
    assert len(folders_read(store.runs("d/=3"))) <= months
    assert sorted(r.rows for r in store.runs("d/=3").collect()) == list(range(3, 10_000, 7))


def test_a_dataset_with_most_runs_is_read_by_time(spark, tmp_path):
    """Months before the period are no folder of the scan, and a partition filter."""
    store = RunStore(spark, str(tmp_path))
    runs = long_history(spark, 3000)
    low = runs.selectExpr("run_id", "dataset_name", "'low' type", "'high' severity", "'m' message", "timestamp")
    store.replace_runs("alerts", low)
    last = runs.selectExpr("max(timestamp) t").first().t
    since = last - datetime.timedelta(hours=45)
    recent = store.alerts(since)
    plan = recent._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert len({f.rpartition("month=")[2].split("/")[0] for f in recent.inputFiles()}) <= 2
    assert recent.count() == 5
    center = AlertCenter(QualityEngine(spark, str(tmp_path)))
    summary = center.get_alert_summary(45, last)
    assert {r.alerts for r in summary.collect()} == {5}


def test_runs_are_folded_when_enough_have_gathered(spark, tmp_path):
    tmp_path = tmp_path / "a folder%20"
    store = RunStore(spark, str(tmp_path), fresh=4)
    for i in range(11):
        rows = history(spark).limit(1).selectExpr("* EXCEPT (rows)", f"{i}L AS rows")
        store.write("alerts", spark.createDataFrame([], ALERTS), "d", f"run-{i}")
        store.write("runs", rows, "d", f"run-{i}")
    assert sorted(r.rows for r in store.runs().collect()) == list(range(11))
    assert store._manifest()["version"] == 2
    assert len(data_files(tmp_path / "runs")) <= 8 + 3
    # a folded run written again is replaced at once, and for good
    again = history(spark).limit(1).selectExpr("* EXCEPT (rows)", "99L AS rows")
    store.write("runs", again, "d", "run-0")
    for _ in range(2):
        assert sorted(r.rows for r in store.runs().collect()) == [*range(1, 11), 99]
        assert [r.rows for r in store.of_run("runs", "run-0").collect()] == [99]
        assert store.fold()
    assert len(data_files(tmp_path / "runs")) <= 3


def test_a_run_moves_to_another_month(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    rows = history(spark).limit(1)
    store.write("runs", rows, "d", "run")
    store.fold()
    store.write("runs", rows.withColumn("timestamp", F.lit(DAY + datetime.timedelta(days=90))), "d", "run")
    store.fold()
    assert store.runs().count() == store.of_run("runs", "run").count() == 1


def test_a_run_without_rows_replaces_one_with_rows(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    alert = spark.createDataFrame([("r", "d", "t", "high", "m", DAY)], "run_id string, dataset_name string, "
                                  "type string, severity string, message string, timestamp timestamp")
    store.write("alerts", alert, "d", "r")
    store.fold()
    assert store.alerts().count() == 1
    store.write("alerts", alert.limit(0), "d", "r")
    assert store.alerts().count() == store.of_run("alerts", "r").count() == 0
    store.fold()
    assert store.alerts().count() == 0


def test_same_run_id_in_two_datasets(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    for name in "ab":
        store.write("runs", history(spark).limit(1), name, "run")
    for _ in range(2):
        assert sorted(r.dataset_name for r in store.of_run("runs", "run").collect()) == ["a", "b"]
        assert [r.dataset_name for r in store.of_run("runs", "run", "b").collect()] == ["b"]
        store.fold()


def test_of_two_folds_one_gives_way(spark, tmp_path, monkeypatch):
    first, second = (RunStore(spark, str(tmp_path)) for _ in range(2))
    first.write("runs", history(spark).limit(1), "d", "one")
    publish = first._publish

    def late(manifest):
        first.write("runs", history(spark).limit(1), "d", "two")
        assert second.fold()
        return publish(manifest)

    monkeypatch.setattr(first, "_publish", late)
    assert not first.fold()
    assert sorted(r.run_id for r in second.runs().collect()) == ["one", "two"]
    assert second._manifest()["version"] == 1
    # rows given are folded after all
    monkeypatch.undo()
    first.replace_runs("runs", long_history(spark, 300))
    assert second.runs().count() == 302


def test_a_fold_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path))
    store.replace_runs("runs", long_history(spark, 300))
    store.write("runs", history(spark).limit(1), "d", "one")

    def broken(manifest):
        raise OSError("gone")

    monkeypatch.setattr(store, "_publish", broken)
    with pytest.raises(OSError):
        store.fold()
    monkeypatch.undo()
    assert store.runs().count() == 301 and store.fold() and store.runs().count() == 301


def test_many_runs_replace_fresh_ones(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.replace_runs("runs", long_history(spark, 5, "-1D"))
    store.replace_runs("runs", long_history(spark, 300))
    assert store.runs().filter("quality_score < 0").count() == 0 and store.runs().count() == 300


def test_pandas_intake(spark, engine, people):
    pandas = people.toPandas()
    df = from_pandas(spark, pandas, "people_view")
    assert read_table(spark, "people_view").count() == df.count() == 5
    run = engine.run_comprehensive_quality_check(pandas, save_metrics=False)
    assert engine.calculate_quality_score(run.results).first().quality_score == 75.0


# ---------------------------------------------------------------- queries on runs


def test_history_order_filter_and_limit(spark):
    runs = history(spark)
    assert [r.run_id for r in R.run_history(runs, "b").collect()] == [
        f"r{i:02d}" for i in range(0, 20, 3)
    ]
    assert [r.run_id for r in R.run_history(runs, limit=3).collect()] == ["r17", "r18", "r19"]
    assert R.run_history(runs, limit=0).count() == 20


def test_recent_runs_and_trend(spark):
    recent = R.recent_runs(history(spark), 2).collect()
    assert sorted((r.dataset_name, r.recency, r.run_id) for r in recent) == [
        ("a", 1, "r19"), ("a", 2, "r17"), ("b", 1, "r18"), ("b", 2, "r15"),
    ]
    trend = R.score_trend(history(spark), 1).collect()
    assert sorted((r.dataset_name, r.quality_score) for r in trend) == [("a", 19.0), ("b", 18.0)]


def test_summary_uses_population_deviation(spark):
    rows = by(R.dataset_summary(history(spark)), "dataset_name")
    assert rows["b"].total_runs == 7
    assert rows["b"].score_std == pytest.approx(6.0)
    status = R.history_status(history(spark)).first()
    assert (status.total_runs, status.last_updated) == (20, DAY + datetime.timedelta(hours=19))


def test_run_table_rounds_ties_to_even(spark):
    runs = history(spark).limit(1).selectExpr(
        "run_id", "dataset_name", "timestamp", "66.125D AS quality_score", "rows", "columns",
        "metrics_file", "status",
    )
    row = R.run_table(runs).first()
    assert (row.timestamp, row.quality_score) == ("2024-05-01 12:00:00", 66.12)
    assert R.run_table(runs).columns == [
        "run_id", "dataset_name", "timestamp", "quality_score", "rows", "columns", "status",
    ]
    assert R.run_headline(runs, "r00").first().quality_score == 66.125
    assert R.dataset_names(history(spark)).count() == 2


def test_a_fold_works_out_rows_few_times(spark, tmp_path):
    """Four times at most: no further time for the bounds of a range."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    store = RunStore(spark, str(tmp_path))
    runs = long_history(spark, 3000)
    for _ in range(2):  # the second time over rows that are folded already
        read.value = 0
        store.replace_runs("runs", runs.mapInArrow(counted, runs.schema))
        assert 0 < read.value <= 4 * 3000
        assert store.runs().count() == 3000
