import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.catalog.views import events_f
from plumbline.engine import AlertCenter, QualityEngine
from plumbline.operators import alerts as A
from plumbline.operators import anomalies as Z
from plumbline.operators import suite as S
from plumbline.operators.alerts import AlertRule
from plumbline.sources import RunStore
from plumbline.sources.rules import RuleTable
from plumbline.streaming.letters import DeadLetters
from plumbline.streaming.monitor import replay_failed
from plumbline.streaming.windows import rows_without_time
from plumbline.streaming import distinct_by_window, quality_by_window, run_cycle, start_monitoring

NOW = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def test_cycle_stores_everything_and_agrees_with_the_operators(spark, folder, store):
    events = events_f(spark, folder)
    config = A.AlertConfig(
        thresholds=A.Thresholds(quality_score_min=100.0, anomaly_percentage_max=1.0),
        webhook=A.WebhookChannel(enabled=True, url="https://example.com"),
    )
    done = run_cycle(events, "events", store, config, run_id="r1", timestamp=NOW)
    results = S.run_suite(events)
    assert done.quality_score == S.quality_score(results).first().quality_score
    assert store.run_metrics("r1").count() == results.count()
    expected = {r.column_name: r for r in Z.detect_anomalies(events).collect()}
    for row in store.run_anomalies("r1").collect():
        assert row.anomaly_count == expected[row.column_name].anomaly_count
        assert row.lower_bound == pytest.approx(expected[row.column_name].lower_bound)
    record = store.runs().first()
    assert (record.rows, record["columns"], record.timestamp) == (10200, 6, NOW)
    alerts = store.alerts()
    assert alerts.count() == done.alert_count == store.read("outbox").count()
    types = {r.type for r in alerts.select("type").distinct().collect()}
    assert types == {"quality_score_low", "uniqueness_failure", "completeness_failure", "anomaly_detected"} - (
        set() if alerts.filter("type = 'completeness_failure'").count() else {"completeness_failure"}
    )


def test_repeating_a_cycle_leaves_one_run(people, store):
    for _ in range(2):
        run_cycle(people, "people", store, run_id="r1", timestamp=NOW)
    assert store.runs().count() == 1
    first = store.alerts().count()
    run_cycle(people, "people", store, A.AlertConfig(thresholds=A.Thresholds(0.0, 100.0, 0.0, 0.0)), run_id="r1")
    assert first > 0
    assert store.alerts().count() == 0


def test_run_once_takes_a_source_function(spark, people, tmp_path):
    center = AlertCenter(QualityEngine(spark, str(tmp_path)))
    done = center.run_once(lambda: people, "people", timestamp=NOW)
    assert done.quality_score == 75.0
    assert center.store.runs().first().dataset_name == "people"


def test_stream_runs_a_cycle_per_batch(spark, people, store, tmp_path):
    source = str(tmp_path / "in")
    people.coalesce(1).write.parquet(source)
    people.limit(2).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def go():
        query = start_monitoring(
            stream, "people", store, checkpoint=str(tmp_path / "checkpoint"), available_now=True,
            on_cycle=seen.append,
        )
        assert query.awaitTermination(180)

    go()
    assert [c.run_id[-11:] for c in seen] == ["-0000000000", "-0000000001"]
    assert len({c.run_id[:-11] for c in seen}) == 1
    assert sorted(r.rows for r in store.runs().collect()) == [2, 5]
    full = [r for r in store.runs().collect() if r.rows == 5][0]
    assert full.quality_score == 75.0
    # nothing new, nothing done; one more file, one more run
    go()
    people.limit(1).coalesce(1).write.mode("append").parquet(source)
    go()
    assert sorted(r.rows for r in store.runs().collect()) == [1, 2, 5]


def test_stream_that_only_says_when(spark, people, store, tmp_path):
    ticks = str(tmp_path / "ticks")
    spark.range(1).write.parquet(ticks)
    query = start_monitoring(
        spark.readStream.schema("id bigint").parquet(ticks), "people", store,
        checkpoint=str(tmp_path / "checkpoint"), available_now=True, source=lambda: people,
    )
    assert query.awaitTermination(180)
    assert [(r.rows, r.quality_score) for r in store.runs().collect()] == [(5, 75.0)]


def test_stream_windows_equal_batch_windows(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    source = str(tmp_path / "events")
    ordered = events.repartitionByRange(3, "ts").sortWithinPartitions("ts")
    ordered.write.parquet(source)
    batch = quality_by_window(
        events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["value", "event_type"]
    )
    stream = quality_by_window(
        spark.readStream.schema(events.schema).parquet(source),
        "ts", "1 day", ["value", "event_type"], watermark="1 hour",
    )
    query = (
        stream.writeStream.format("memory").queryName("windowed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180)
    closed = spark.table("windowed")
    expected = {tuple(r) for r in batch.collect()}
    found = {tuple(r) for r in closed.collect()}
    # the last window stays open: the watermark does not pass its end
    last = batch.agg(F.max("window_start")).first()[0]
    assert found == {r for r in expected if r[0] != last}


def test_window_distinct_counts(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    rows = quality_by_window(events, "ts", "30 days", ["event_type"], approx_distinct_error=0.02)
    exact = events.agg(F.count_distinct("event_type")).first()[0]
    assert {r.approx_distinct for r in rows.collect()} == {exact}


def test_exact_distinct_counts_of_odd_values(spark):
    rows = [
        ("2024-01-01 00:10:00", 0.0, "x" * 100, [1]),
        ("2024-01-01 00:20:00", -0.0, "x" * 99 + "y", [1]),
        ("2024-01-01 00:30:00", float("nan"), "", [2]),
        ("2024-01-01 01:30:00", None, None, None),
        (None, 5.0, "late", [3]),
    ]
    df = spark.createDataFrame(rows, "t string, `a.b` double, s string, l array<int>")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    found = distinct_by_window(df, "t", "1 hour").collect()
    got = {(r.window_start.hour, r.column_name): tuple(r)[3:] for r in found}
    assert got == {
        (0, "a.b"): (3, 2, 1), (0, "s"): (3, 3, 3), (0, "l"): (3, 3, 2),
        (1, "a.b"): (1, 0, 0), (1, "s"): (1, 0, 0), (1, "l"): (1, 0, 0),
    }
    assert distinct_by_window(df.limit(0), "t", "1 hour").count() == 0


def test_streamed_distinct_counts_drop_the_state_of_closed_windows(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    source = str(tmp_path / "events")
    for step, part in enumerate(events.orderBy("ts").randomSplit([1.0] * 3, 1)):
        part.sortWithinPartitions("ts").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        distinct_by_window(stream, "ts", "1 day", ["user_id"], watermark="400 days")
        .writeStream.format("memory").queryName("distincts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180)
    assert spark.table("distincts").count() == 0  # nothing is closed, everything is state
    held = query.lastProgress["stateOperators"]
    assert max(s["numRowsTotal"] for s in held) == events.groupBy(
        F.to_date("ts"), "user_id"
    ).count().count()


def write_source(people, tmp_path, name="in"):
    people.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return people.sparkSession.readStream.schema(people.schema).parquet(f"{tmp_path}/{name}")


def watch(stream, store, **options):
    query = start_monitoring(stream, "people: a/b", store, available_now=True, **options)
    assert query.awaitTermination(180)


def test_stores_do_not_share_a_default_checkpoint(spark, people, tmp_path):
    stream = write_source(people, tmp_path)
    stores = [RunStore(spark, f"{tmp_path}/{name}") for name in ("one", "two")]
    for store in stores:
        watch(stream, store)
        watch(stream, store)  # resumes, and finds nothing new
    assert [store.runs().count() for store in stores] == [1, 1]


def test_fresh_checkpoint_leaves_older_runs(people, store, tmp_path):
    stream = write_source(people, tmp_path)
    for name in ("first", "second"):
        watch(stream, store, checkpoint=f"{tmp_path}/{name}")
    assert store.runs().count() == 2


def test_failed_cycle_is_recorded(people, store, tmp_path):
    stream = write_source(people, tmp_path)

    def broken():
        raise ValueError("no such table")

    watch(stream, store, source=broken, go_on=True)
    run = store.runs().first()
    assert (run.status, run.rows, run.quality_score) == ("failed", None, None)
    alert = store.alerts().first()
    assert alert.type == "system_error" and "no such table" in alert.message


def test_rows_without_time_are_counted(spark):
    df = spark.sql(
        "SELECT CAST(t AS TIMESTAMP) AS t, v FROM VALUES ('2024-01-01 10:10:00', 1), (NULL, -1), "
        "(NULL, NULL) AS x(t, v)"
    )
    rows = {r.window_start: r for r in quality_by_window(df, "t", "1 hour").collect()}
    assert sum(r.total_count for r in rows.values()) == 3
    untimed = rows[None]
    assert (untimed.window_end, untimed.total_count, untimed.null_count) == (None, 2, 1)
    assert untimed.status == "Failure"
    assert tuple(rows_without_time(df, "t").first()) == (2, 3)


def test_a_batch_that_keeps_failing_is_kept(spark, tmp_path):
    store, calls = RunStore(spark, str(tmp_path / "s")), []
    folder = str(tmp_path / "in")
    for i in range(4):
        spark.range(i, i + 1).selectExpr("id", "CAST(id AS STRING) AS name").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id bigint, name string").option("maxFilesPerTrigger", 1).parquet(folder)

    def prepare(rows):
        calls.append(1)
        if rows.first().id == 0:
            raise RuntimeError("never good")
        return rows

    start_monitoring(
        stream, "d", store, available_now=True, go_on=True, tries=2, prepare=prepare
    ).awaitTermination()
    letters = DeadLetters(store, "d")
    kept = letters.table().collect()
    assert len(kept) == 1 and (kept[0].tries, kept[0].error) == (2, "never good")
    assert sorted(r.status for r in store.runs().collect()) == ["completed"] * 3 + ["failed"]
    assert replay_failed(store, "d", tries=2) == []
    done = replay_failed(store, "d")
    assert [c.run_id for c in done] == [kept[0].run_id] and letters.letters() == []
    assert sorted((r.status, r.rows) for r in store.runs().collect()) == [("completed", 1)] * 4


def test_rules_outlast_the_session(spark, tmp_path):
    table = RuleTable(spark, str(tmp_path / "rules"))
    assert table.rules() == ()
    rule = AlertRule("r", "completeness", "null_count", ">", 1.0, ("email",), "high", "id")
    table.add(rule, datetime.datetime(2024, 1, 1))
    table.add(replace(rule, value=2.0), datetime.datetime(2024, 1, 2))
    again = RuleTable(spark, str(tmp_path / "rules"))
    assert again.rules() == (replace(rule, value=2.0),)
    assert again.current().first().created_at == datetime.datetime(2024, 1, 2)
    again.remove("r")
    assert table.rules() == () and table.history().count() == 3
    with pytest.raises(ValueError):
        table.add(replace(rule, op="~"))
