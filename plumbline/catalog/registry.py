"""One registered query per operator, over whole tables.

Doubles are rounded and timestamps rendered as text only here, for the comparison with
another engine; the operators return full values.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.views import (
    customer_f,
    events_f,
    events_f_stream,
    mail_f,
    runs_f,
    table,
    faulted_events,
)
from plumbline.engine import AlertCenter, QualityEngine
from plumbline.operators import alerts as A
from plumbline.operators import anomalies as Z
from plumbline.operators import checks as C
from plumbline.operators import duplicates as D
from plumbline.operators import issues as I
from plumbline.operators import profile as P
from plumbline.operators import runs as R
from plumbline.operators import suite as S
from plumbline.operators.incremental import States
from plumbline.operators.observed import written_and_measured
from plumbline.sources.pinning import checkpoint_folder, pin
from plumbline.sources.store import ALERTS, RunStore
from plumbline.sources.tables import read_table
from plumbline.streaming import distinct_by_window, quality_by_window, start_monitoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLDS = A.Thresholds()
CHANNELS = A.AlertConfig(
    email=A.EmailChannel(enabled=True, recipients=("quality@example.com",)),
    webhook=A.WebhookChannel(enabled=True, url="https://hooks.example.com/quality"),
)
RULES = (
    A.AlertRule("many_missing", "completeness", "null_count", ">", 0),
    A.AlertRule(
        "too_short", "text_quality", "short_ratio", ">=", 0.25, ("webhook",), "low"
    ),
    A.AlertRule(
        "huge_balance", "consistency", "outlier_count", ">", 0, column_name="c_acctbal"
    ),
)
CUSTOMER_RANGES = {"c_acctbal": {"min": 0.0, "max": 9000.0}, "c_nationkey": {"min": 5}}
CUSTOMER_PATTERNS = {"c_name": "^Customer#[0-9]+$", "c_mktsegment": "^[A-Z]+$"}


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


RUN_TIME = "2024-01-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: F.round(F.col(n), digits) for n in doubles})


def texted(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: R.to_seconds(name) for name in names})


def without_error(df: DataFrame) -> DataFrame:
    return rounded(df.drop("error"))


# ------------------------------------------------------------------ checks


@query
def completeness(spark, folder):
    return without_error(C.completeness(customer_f(spark, folder)))


@query
def uniqueness(spark, folder):
    orders = C.uniqueness(table(spark, folder, "orders"))
    return without_error(orders.unionByName(C.uniqueness(customer_f(spark, folder))))


@query
def consistency(spark, folder):
    parts = [
        C.consistency(source)
        for source in (
            customer_f(spark, folder),
            table(spark, folder, "supplier"),
            table(spark, folder, "lineitem"),
        )
    ]
    return without_error(A.union_alerts(*parts))


@query
def range_check(spark, folder):
    lines = C.range_check(
        table(spark, folder, "lineitem"),
        {"l_quantity": {"min": 5, "max": 45}, "l_discount": {"max": 0.1}},
    )
    customers = C.range_check(customer_f(spark, folder), CUSTOMER_RANGES)
    return without_error(lines.unionByName(customers).drop("min", "max"))


@query
def pattern_check(spark, folder):
    parts = C.pattern_check(table(spark, folder, "part"), {"p_brand": "^Brand#[1-3]"})
    customers = C.pattern_check(customer_f(spark, folder), CUSTOMER_PATTERNS)
    return without_error(parts.unionByName(customers))


@query
def text_quality(spark, folder):
    documents = C.text_quality(table(spark, folder, "documents"))
    turns = C.text_quality(table(spark, folder, "conversations"))
    return without_error(documents.unionByName(turns))


@query
def email_format(spark, folder):
    return without_error(C.email_format(mail_f(spark, folder)))


@query
def spam_indicator(spark, folder):
    return without_error(C.spam_indicator(mail_f(spark, folder)))


@query
def sentiment_validity(spark, folder):
    return without_error(C.sentiment_validity(mail_f(spark, folder)))


@query
def email_bundle(spark, folder):
    return without_error(C.mail_checks(mail_f(spark, folder)))


# ------------------------------------------------------------------ suite


def customer_suite(spark, folder, **options) -> DataFrame:
    return S.run_suite(
        customer_f(spark, folder), CUSTOMER_RANGES, CUSTOMER_PATTERNS, **options
    )


def customer_run(spark, folder) -> DataFrame:
    """The suite's results with their run, as they would be stored."""
    return customer_suite(spark, folder, profile=False).select(
        "*",
        F.lit("customer-1").alias("run_id"),
        F.lit("customer").alias("dataset_name"),
        at(RUN_TIME).alias("timestamp"),
    )


@query
def suite_results(spark, folder):
    """Status of every check plus the unfolded metrics behind it."""
    return rounded(S.suite_metrics(customer_suite(spark, folder, profile=False)))


@query
def mail_suite_results(spark, folder):
    results = S.run_suite(mail_f(spark, folder), profile=False)
    return rounded(S.suite_metrics(results))


@query
def quality_score(spark, folder):
    return rounded(S.quality_score(customer_suite(spark, folder, profile=False)))


@query
def check_type_summary(spark, folder):
    return S.check_type_summary(customer_suite(spark, folder, profile=False))


@query
def status_by_check(spark, folder):
    """Results per check type and status, some checks being impossible to run."""
    results = S.run_suite(
        customer_f(spark, folder),
        CUSTOMER_RANGES | {"nowhere": {"min": 0}, "c_name": {"max": 1}},
        CUSTOMER_PATTERNS | {"c_custkey": "^1"},
    )
    return results.groupBy("check_type", "status").agg(
        F.count(F.lit(1)).alias("results")
    )


@query
def dataset_info(spark, folder):
    return S.dataset_info(table(spark, folder, "orders"))


# ------------------------------------------------------------------ issues


@query
def missing_by_column(spark, folder):
    return rounded(I.missing_by_column(customer_f(spark, folder)))


@query
def total_missing(spark, folder):
    return I.total_missing(customer_f(spark, folder))


@query
def duplicate_rows(spark, folder):
    return D.duplicate_rows(events_f(spark, folder))


@query
def duplicate_groups(spark, folder):
    return D.duplicate_groups(events_f(spark, folder)).select(
        "event_id", "event_type", F.round("value", 6).alias("value"), "copies"
    )


@query
def issue_summary(spark, folder):
    """The summary with its nested parts unfolded."""
    summary = I.issue_summary(events_f(spark, folder))
    return rounded(
        summary.select(
            "total_rows",
            "total_columns",
            "duplicate_rows",
            F.array_join("numeric_columns", ",").alias("numeric_columns"),
            F.array_join("categorical_columns", ",").alias("categorical_columns"),
            F.array_join(
                F.transform(
                    "data_types",
                    lambda t: F.concat(t["column_name"], F.lit(":"), t["data_type"]),
                ),
                ",",
            ).alias("data_types"),
            F.inline("missing_values"),
        )
    )


# ------------------------------------------------------------------ profile


@query
def column_profile(spark, folder):
    return rounded(P.column_profile(table(spark, folder, "lineitem")), 4)


@query
def column_card(spark, folder):
    return rounded(P.column_card(table(spark, folder, "orders")), 4)


@query
def constraint_suggestions(spark, folder):
    return P.suggest_constraints(table(spark, folder, "lineitem"))


@query
def dtype_distribution(spark, folder):
    return P.dtype_distribution(customer_f(spark, folder))


@query
def describe_numeric(spark, folder):
    return rounded(P.describe(table(spark, folder, "lineitem")), 4)


@query
def numeric_histogram(spark, folder):
    return rounded(P.histogram(events_f(spark, folder), ["value", "user_id"]), 4)


@query
def top_values(spark, folder):
    return P.top_values(
        table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


@query
def top_texts(spark, folder):
    """Top values of long texts."""
    return P.top_values(table(spark, folder, "documents"), ["text", "lang"], 5)


@query
def uniqueness_wide(spark, folder):
    """Distinct vectors and texts."""
    vectors = C.uniqueness(table(spark, folder, "embeddings"))
    return without_error(vectors.unionByName(C.uniqueness(table(spark, folder, "pages"))))


# ------------------------------------------------------------------ anomalies


def event_bands(spark, folder):
    events = events_f(spark, folder)
    return events, Z.fit_bands(events, ["value", "user_id"])


@query
def anomaly_stats(spark, folder):
    return rounded(Z.detect_anomalies(events_f(spark, folder)), 4)


@query
def anomaly_rows(spark, folder):
    events, bands = event_bands(spark, folder)
    return rounded(Z.anomaly_rows(events, bands, ["event_id", "event_type"]), 4)


@query
def anomaly_headline(spark, folder):
    return rounded(Z.anomaly_headline(Z.detect_anomalies(events_f(spark, folder))))


@query
def anomaly_histogram(spark, folder):
    events, bands = event_bands(spark, folder)
    return rounded(Z.anomaly_histogram(events, bands, bins=10), 4)


# ------------------------------------------------------------------ run history


@query
def run_history(spark, folder):
    runs = R.run_history(runs_f(spark, folder), "ds_2", 25)
    return texted(rounded(runs.drop("metrics_file")), "timestamp")


@query
def last_n_runs(spark, folder):
    runs = R.recent_runs(runs_f(spark, folder), 5)
    return texted(rounded(runs.drop("metrics_file")), "timestamp")


@query
def dataset_score_summary(spark, folder):
    summary = R.dataset_summary(runs_f(spark, folder))
    return texted(rounded(summary), "first_run", "last_run")


@query
def score_trend(spark, folder):
    return texted(rounded(R.score_trend(runs_f(spark, folder))), "timestamp")


@query
def history_status(spark, folder):
    return texted(R.history_status(runs_f(spark, folder)), "last_updated")


@query
def dataset_names(spark, folder):
    return R.dataset_names(runs_f(spark, folder))


@query
def run_table(spark, folder):
    return R.run_table(runs_f(spark, folder))


@query
def run_headline(spark, folder):
    return rounded(R.run_headline(runs_f(spark, folder)))


_HISTORIES: dict[tuple[str, str], str] = {}


def stored_history(spark, folder) -> QualityEngine:
    """An engine over a store with the runs of ``runs_f`` and their low-score alerts.

    A seventh of the runs is first stored with another score, folded, and stored again. The
    store is written once per application and folder.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _HISTORIES:
        path = new_folder(spark)
        store = RunStore(spark, path)
        runs = runs_f(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        again = F.col("rows") % 7 == 0
        store.replace_runs("runs", runs.filter(again).withColumn("quality_score", F.lit(-1.0)))
        store.replace_runs("runs", runs)
        store.replace_runs("alerts", A.score_alerts(store.runs(), A.Thresholds(40.0)))
        _HISTORIES[key] = path
    return QualityEngine(spark, _HISTORIES[key])


@query
def stored_run_history(spark, folder):
    runs = stored_history(spark, folder).get_run_history("ds_2", 25)
    return texted(rounded(runs.drop("metrics_file")), "timestamp")


@query
def stored_last_n_runs(spark, folder):
    runs = stored_history(spark, folder).get_recent_runs(5)
    return texted(rounded(runs.drop("metrics_file")), "timestamp")


@query
def stored_score_summary(spark, folder):
    return texted(rounded(stored_history(spark, folder).get_dataset_summary()), "first_run", "last_run")


@query
def stored_score_trend(spark, folder):
    return texted(rounded(stored_history(spark, folder).get_score_trend()), "timestamp")


@query
def stored_alert_summary(spark, folder):
    """Alerts of the history's last year; older months are not read."""
    center = AlertCenter(stored_history(spark, folder))
    return center.get_alert_summary(24 * 365, datetime.datetime(1998, 8, 1))


# ------------------------------------------------------------------ alerts

ALERT_COLUMNS = (
    "run_id",
    "dataset_name",
    "type",
    "severity",
    "message",
    "timestamp",
    "column_name",
    "value",
    "threshold",
    "anomaly_percentage",
    "anomaly_count",
)


def shown(alerts: DataFrame) -> DataFrame:
    return texted(rounded(alerts.select(*ALERT_COLUMNS)), "timestamp")


def customer_quality_alerts(spark, folder, rules=()) -> DataFrame:
    results = pin(customer_run(spark, folder))
    record = S.run_record(results, "customer", "customer-1", at(RUN_TIME))
    return A.quality_alerts(record, results, THRESHOLDS, rules)


def event_anomaly_alerts(spark, folder) -> DataFrame:
    counts = Z.detect_anomalies(events_f(spark, folder), ["value", "user_id"], 1.0)
    run = counts.select(
        "*",
        F.lit("events-1").alias("run_id"),
        F.lit("events").alias("dataset_name"),
        at(RUN_TIME).alias("timestamp"),
    )
    return A.anomaly_alerts(run, THRESHOLDS)


@query
def alerts_score(spark, folder):
    return shown(A.score_alerts(runs_f(spark, folder), A.Thresholds(40.0)))


@query
def alerts_completeness(spark, folder):
    return shown(A.completeness_alerts(customer_run(spark, folder)))


@query
def alerts_uniqueness(spark, folder):
    return shown(A.uniqueness_alerts(customer_run(spark, folder)))


@query
def alerts_anomaly(spark, folder):
    return shown(event_anomaly_alerts(spark, folder))


@query
def alerts_union(spark, folder):
    return shown(
        A.union_alerts(
            customer_quality_alerts(spark, folder), event_anomaly_alerts(spark, folder)
        )
    )


@query
def alert_summary(spark, folder):
    """Low-score alerts of the whole history, summed up over its last year."""
    low = A.score_alerts(runs_f(spark, folder), THRESHOLDS)
    both = A.union_alerts(
        low.withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        customer_quality_alerts(spark, folder).withColumn(
            "timestamp", at("1998-07-01")
        ),
    )
    return A.alert_summary(both, at("1998-08-01"), hours=24 * 365)


@query
def alert_rules(spark, folder):
    return shown(A.rule_alerts(customer_run(spark, folder), RULES))


@query
def alert_outbox(spark, folder):
    alerts = customer_quality_alerts(spark, folder, RULES)
    return A.outbox(alerts, CHANNELS).select(
        "channel",
        F.array_join("recipients", ",").alias("recipients"),
        "type",
        "subject",
        F.substring_index("body", "\n\nAdditional Details:", 1).alias("body"),
        F.get_json_object("payload", "$.message").alias("payload_message"),
    )


@query
def alert_payloads(spark, folder):
    """Every field of the payloads, and whether a message's details are its payload."""
    alerts = customer_quality_alerts(spark, folder, RULES)
    details = F.substring_index("body", "Additional Details:\n", -1)
    sent = A.outbox(alerts, CHANNELS).select(
        "channel",
        (details == F.col("payload")).alias("details_are_payload"),
        F.inline(F.array(F.from_json("payload", ALERTS))),
    )
    return rounded(
        sent.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("actions", F.array_join("actions", ","))
    )


# ------------------------------------------------------------------ monitoring


@query
def windowed_quality(spark, folder):
    quality = quality_by_window(
        events_f(spark, folder), "ts", "1 hour", ["value", "event_type"]
    )
    return texted(rounded(quality), "window_start", "window_end")


@query
def windowed_untimed(spark, folder):
    """Windows over events of which some have no time."""
    events = events_f(spark, folder)
    gaps = events.withColumn("ts", F.when(F.col("event_id") % 30 != 11, F.col("ts")))
    quality = quality_by_window(gaps, "ts", "1 day", ["value", "event_type"])
    return texted(rounded(quality), "window_start", "window_end")


@query
def monitor_cycle(spark, folder):
    """What a cycle over the events raises: one row per alert."""
    engine = QualityEngine(spark, new_folder(spark))
    center = AlertCenter(engine, A.AlertConfig(thresholds=A.Thresholds(100.0)))
    center.run_once(
        lambda: events_f(spark, folder),
        "events",
        run_id="events-1",
        timestamp=datetime.datetime(2024, 1, 1),
        anomaly_threshold=1.0,
        # the registered anomaly alerts look at these two columns
    )
    return shown(engine.store.alerts())


@query
def alerts_system(spark, folder):
    """Alerts of checks that could not be run."""
    results = S.run_suite(
        customer_f(spark, folder),
        {"nowhere": {"min": 0}, "c_name": {"max": 1}},
        {"c_custkey": "^1"},
        profile=False,
    )
    run = results.select(
        "*",
        F.lit("customer-2").alias("run_id"),
        F.lit("customer").alias("dataset_name"),
        at(RUN_TIME).alias("timestamp"),
    )
    alerts = A.result_alerts(run).filter("type = 'system_error'")
    return alerts.select("dataset_name", "severity", "message", "column_name")


@query
def anomaly_infinite(spark, folder):
    """Counts over events of which some have an infinite value."""
    events = events_f(spark, folder)
    huge = events.withColumn(
        "value", F.when(F.col("event_id") % 5000 == 7, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    counts = Z.detect_anomalies(huge, ["value", "user_id"])
    return rounded(counts.select("column_name", "anomaly_count", "anomaly_percentage", "total_count"))


@query
def intake(spark, folder):
    """Completeness of a table taken in by path."""
    return without_error(C.completeness(read_table(spark, f"{folder}/customer.parquet")))


@query
def cleared_alerts(spark, folder):
    """What is kept when alerts are processed, cleared, and others processed twice."""
    center = AlertCenter(QualityEngine(spark, new_folder(spark)))
    center.process_alerts(customer_quality_alerts(spark, folder))
    center.clear_alert_history()
    later = event_anomaly_alerts(spark, folder)
    center.process_alerts(later)
    center.process_alerts(later)
    return shown(center.store.alerts())


# ------------------------------------------------------------------ stores, streams


def new_folder(spark: SparkSession) -> str:
    """A folder of this call's own, next to the checkpoints."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4()}"


def saved_customer_run(spark, folder) -> tuple[QualityEngine, str]:
    engine = QualityEngine(spark, new_folder(spark))
    run = engine.run_comprehensive_quality_check(
        customer_f(spark, folder),
        CUSTOMER_RANGES,
        CUSTOMER_PATTERNS,
        dataset_name="customer",
        profile=False,
    )
    return engine, run.run_id


@query
def saved_run(spark, folder):
    """The history after one stored run; its id and time differ from call to call."""
    engine, _ = saved_customer_run(spark, folder)
    history = engine.get_run_history("customer", limit=10)
    return rounded(
        history.select("dataset_name", "quality_score", "rows", "columns", "status")
    )


@query
def saved_metrics(spark, folder):
    """Results read back from the store by run id."""
    engine, run_id = saved_customer_run(spark, folder)
    return rounded(S.suite_metrics(engine.get_run_metrics(run_id)))


@query
def exported_metrics(spark, folder):
    """The exported JSON document, taken apart again."""
    engine, run_id = saved_customer_run(spark, folder)
    path = new_folder(spark)
    engine.download_metrics_json(run_id, path)
    schema = (
        "dataset_name string, metrics struct<dataset_info: struct<rows: bigint, "
        "columns: int>, overall_quality_score: double, quality_checks: "
        "array<struct<check_type: string, constraint: string, status: string>>>"
    )
    document = spark.read.schema(schema).json(path)
    return rounded(
        document.select(
            "dataset_name",
            "metrics.dataset_info.rows",
            "metrics.dataset_info.columns",
            F.col("metrics.overall_quality_score").alias("quality_score"),
            F.inline("metrics.quality_checks"),
        )
    )


@query
def streamed_cycle(spark, folder):
    """The alerts of a monitoring cycle run on a stream of the events."""
    path = new_folder(spark)
    store = RunStore(spark, f"{path}/store")
    start_monitoring(
        events_f_stream(spark, folder),
        "events",
        store,
        A.AlertConfig(thresholds=A.Thresholds(100.0)),
        checkpoint=f"{path}/checkpoint",
        available_now=True,
        anomaly_threshold=1.0,
    ).awaitTermination()
    alerts = store.alerts().select(*ALERT_COLUMNS)
    return rounded(alerts.drop("run_id", "timestamp"))


@query
def streamed_windows(spark, folder):
    """Quality per hour on a stream, written once the watermark has closed the hour."""
    path = new_folder(spark)
    quality = quality_by_window(
        events_f_stream(spark, folder),
        "ts",
        "1 hour",
        ["value", "event_type"],
        watermark="1 hour",
    )
    (
        quality.writeStream.format("parquet")
        .option("path", f"{path}/windows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    windows = spark.read.schema(quality.schema).parquet(f"{path}/windows")
    return texted(rounded(windows), "window_start", "window_end")


@query
def streamed_distinct(spark, folder):
    """Exact distinct counts per hour on a stream, for the hours the watermark has closed."""
    path = new_folder(spark)
    distinct = distinct_by_window(
        events_f_stream(spark, folder),
        "ts",
        "1 hour",
        ["user_id", "value", "event_type"],
        watermark="1 hour",
    )
    (
        distinct.writeStream.format("parquet")
        .option("path", f"{path}/windows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    windows = spark.read.schema(distinct.schema).parquet(f"{path}/windows")
    return texted(windows, "window_start", "window_end")


@query
def grown_measures(spark, folder):
    """Measures of the events after the table has grown in three steps; each scans new files."""
    path = new_folder(spark)
    states = States(spark, f"{path}/states")
    events = table(spark, folder, "events")
    for step in range(3):
        events.filter(F.col("event_id") % 3 == step).write.mode("append").parquet(f"{path}/events")
        grown = states.take_in(spark.read.parquet(f"{path}/events"), faulted_events)
    return rounded(grown.measures)


def event_files(spark, folder, path: str) -> DataFrame:
    """A stream over the events in three files, one file per batch."""
    events = table(spark, folder, "events")
    for step in range(3):
        events.filter(F.col("event_id") % 3 == step).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def replayed_batches(spark, folder):
    """The runs of a stream whose first batch fails once and is measured later."""
    path = new_folder(spark)
    store = RunStore(spark, f"{path}/store")
    failed = []

    def prepare(rows: DataFrame) -> DataFrame:
        if not failed:
            failed.append(True)
            raise RuntimeError("the first batch fails once")
        return faulted_events(rows)

    start_monitoring(
        event_files(spark, folder, f"{path}/events"), "events", store, available_now=True,
        go_on=True, prepare=prepare,
    ).awaitTermination()
    return store.runs().select("dataset_name", "status", "rows", "columns")


@query
def late_rule(spark, folder):
    """Alerts of a rule added while the stream runs: all batches but the first raise it."""
    path = new_folder(spark)
    center = AlertCenter(QualityEngine(spark, f"{path}/store"))
    rule = A.AlertRule("gaps", "completeness", "null_count", ">", 0.0, column_name="value")

    def add_once(cycle) -> None:
        if not center.rules:
            center.add_alert_rule(rule)

    center.start_monitoring(
        event_files(spark, folder, f"{path}/events"), "events", available_now=True,
        prepare=faulted_events, on_cycle=add_once,
    ).awaitTermination()
    alerts = center.store.alerts().filter("type = 'gaps'")
    return alerts.groupBy("type", "severity", "column_name").agg(F.count(F.lit(1)).alias("alerts"))


@query
def observed_write(spark, folder):
    """Measures of the faulted events, taken while they are written."""
    path = f"{new_folder(spark)}/events"
    return rounded(written_and_measured(events_f(spark, folder), lambda rows: rows.write.parquet(path)))


@query
def uniqueness_with_null(spark, folder):
    """Uniqueness where missing counts as one value."""
    return without_error(C.uniqueness(customer_f(spark, folder), count_null=True))


@query
def top_ties(spark, folder):
    """Top values of a column whose values all occur once and start alike."""
    links = table(spark, folder, "customer").select(
        F.concat(F.lit("https://example.com/" + "customers/" * 6), "c_name").alias("link")
    )
    return P.top_values(links, ["link"], 10)
