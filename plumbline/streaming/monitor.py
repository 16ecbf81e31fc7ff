"""One monitoring cycle, and running it on a stream.

A cycle measures a table, keeps the results, looks for anomalies and raises alerts. The
heavy passes write their few result rows to the store first; score, bands, alerts and
messages are then read off those rows, never computed from the data again.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.alerts import (
    CHECK_ERROR,
    AlertConfig,
    AlertRule,
    anomaly_alerts,
    outbox,
    quality_alerts,
    union_alerts,
)
from plumbline.operators.anomalies import Band, anomaly_counts
from plumbline.operators.checks import Limits
from plumbline.operators.suite import run_record, run_suite
from plumbline.sources.rules import RuleTable
from plumbline.sources.store import (
    ALERT_FIELDS,
    ALERTS,
    RUNS,
    RunStore,
    new_run_id,
    tag,
)
from plumbline.streaming.letters import DeadLetters

#: How often a failed batch is tried while the stream runs.
TRIES = 3


@dataclass(frozen=True)
class Cycle:
    run_id: str
    dataset_name: str
    quality_score: float | None
    alert_count: int


def stored_bands(results: DataFrame, threshold: float) -> dict[str, Band]:
    """Anomaly bands from the profile rows of a run: at most one row per column."""
    rows = (
        results.filter(
            (F.col("check_type") == "data_profile")
            & F.map_contains_key("metrics", "mean")
        )
        .select(
            "column_name",
            F.col("metrics")["mean"].alias("mean"),
            F.col("metrics")["std"].alias("std"),
        )
        .orderBy("column_name")
        .collect()
    )
    return {r.column_name: Band(r.mean, r.std, threshold) for r in rows}


def run_cycle(
    df: DataFrame,
    dataset_name: str,
    store: RunStore,
    config: AlertConfig = AlertConfig(),
    rules: Iterable[AlertRule] = (),
    run_id: str | None = None,
    timestamp: datetime.datetime | None = None,
    anomaly_threshold: float = 2.0,
    limits: Limits | None = None,
    **suite_options: Any,
) -> Cycle:
    """Suite, anomalies and alerts of one table, all stored under one run id.

    The data is scanned once for the fused checks, once per small batch of exactly
    counted columns and once for the anomalies.
    """
    run_id = run_id or new_run_id()
    timestamp = timestamp or datetime.datetime.now()
    limits = limits or config.thresholds.limits()

    results = run_suite(df, limits=limits, profile=True, **suite_options)
    store.save_results(results, dataset_name, run_id, timestamp)
    results = store.read_run("check_results", dataset_name, run_id)

    counts = anomaly_counts(df, stored_bands(results, anomaly_threshold))
    store.save_anomalies(counts, dataset_name, run_id, timestamp)
    counts = store.read_run("anomalies", dataset_name, run_id)

    record = run_record(
        results, dataset_name, run_id, timestamp, store.table_path("check_results")
    )
    alerts = union_alerts(
        quality_alerts(record, results, config.thresholds, rules),
        anomaly_alerts(counts, config.thresholds),
    )
    store.write("alerts", alerts, dataset_name, run_id)
    alerts = store.read_run("alerts", dataset_name, run_id)
    if config.channels():
        store.write("outbox", outbox(alerts, config), dataset_name, run_id)
    store.write("runs", record, dataset_name, run_id)

    score = record.first()["quality_score"]
    return Cycle(run_id, dataset_name, score, alerts.count())


def record_failure(
    dataset_name: str, store: RunStore, run_id: str, error: Exception
) -> Cycle:
    """A run with status ``failed`` and the alert that says why."""
    spark, now = store.spark, datetime.datetime.now()
    said = (str(error).strip().splitlines() or [type(error).__name__])[0]
    alert = {
        "run_id": run_id, "dataset_name": dataset_name, "type": "system_error",
        "severity": "high", "message": CHECK_ERROR.format(said), "timestamp": now,
    }
    rows = spark.createDataFrame([tuple(alert.get(f) for f in ALERT_FIELDS)], ALERTS)
    store.write("alerts", rows, dataset_name, run_id)
    run = (run_id, dataset_name, now, None, None, None, None, "failed")
    store.write("runs", spark.createDataFrame([run], RUNS), dataset_name, run_id)
    return Cycle(run_id, dataset_name, None, 1)


def _lasting_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps in a checkpoint: the same for every start from it."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def as_it_is(rows: DataFrame) -> DataFrame:
    return rows


def _held(store: RunStore, rules: Iterable[AlertRule] | RuleTable) -> tuple[AlertRule, ...]:
    """The rules of this moment, read in the session of the cycle."""
    if isinstance(rules, RuleTable):
        return RuleTable(store.spark, rules.path).rules()
    return tuple(rules)


def replay_failed(
    store: RunStore,
    dataset_name: str,
    config: AlertConfig = AlertConfig(),
    rules: Iterable[AlertRule] | RuleTable = (),
    tries: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] = as_it_is,
    **cycle_options: Any,
) -> list[Cycle]:
    """Measures the batches that failed, each under the run id it had.

    Batches that failed ``tries`` times are left; None tries all of them. A batch that
    fails again is noted and stays.
    """
    letters, done = DeadLetters(store, dataset_name), []
    for letter in letters.letters():
        if tries is not None and letter.tries >= tries:
            continue
        try:
            cycle = run_cycle(
                prepare(letters.rows(letter)), dataset_name, store, config, _held(store, rules),
                run_id=letter.run_id, **cycle_options,
            )
        except Exception as error:
            letters.put(letter.run_id, None, error)
            continue
        letters.settle(letter)
        done.append(cycle)
    return done


def start_monitoring(
    stream: DataFrame,
    dataset_name: str,
    store: RunStore,
    config: AlertConfig = AlertConfig(),
    rules: Iterable[AlertRule] | RuleTable = (),
    checkpoint: str | None = None,
    available_now: bool = False,
    source: Callable[[], DataFrame] | None = None,
    on_cycle: Callable[[Cycle], None] | None = None,
    go_on: bool = False,
    tries: int = TRIES,
    prepare: Callable[[DataFrame], DataFrame] = as_it_is,
    **cycle_options: Any,
) -> StreamingQuery:
    """Run a cycle on every micro-batch of ``stream``, at once and then at the interval.

    With ``source`` a cycle checks the whole table it returns, as it stands when the batch
    arrives; the stream then only says when. Without it the batch itself is checked.

    The checkpoint lies in the store by default, so that stores do not share offsets. The
    run id is made from the dataset, the query's lasting id and the batch number, and a
    run overwrites its own partitions: a batch replayed after a failure leaves one set of
    results, and a query with another checkpoint never replaces them.

    What is checked is what ``prepare`` makes of the batch or the table. Rules from a table
    are read per cycle, so a rule added while the query runs holds from the next batch on.

    A failing cycle fails the query; restarting it repeats that batch. With ``go_on`` the
    failure is recorded instead, as a run with status ``failed`` and a system alert, the
    batch's rows are kept, and the next batch is awaited. Kept batches are tried again when
    the next batch comes, up to ``tries`` times; ``replay_failed`` tries them at any time.
    A whole table from ``source`` is checked again by the next cycle anyway.
    """
    rules = rules if isinstance(rules, RuleTable) else tuple(rules)
    if checkpoint is None:
        checkpoint = f"{store.path}/_checkpoints/{tag(dataset_name)}"

    def cycle(batch: DataFrame, batch_id: int) -> None:
        own = RunStore(batch.sparkSession, store.path)
        run_id = f"{dataset_name}-{_lasting_id(batch.sparkSession, checkpoint)}-{batch_id:010d}"
        done = []
        if go_on and source is None:
            done += replay_failed(own, dataset_name, config, rules, tries, prepare, **cycle_options)
        try:
            done.append(checked(batch, own, run_id))
        except Exception as error:
            if not go_on:
                raise
            if source is None:
                DeadLetters(own, dataset_name).put(run_id, batch, error)
            done.append(record_failure(dataset_name, own, run_id, error))
        for each in done if on_cycle is not None else ():
            on_cycle(each)

    def checked(batch: DataFrame, own: RunStore, run_id: str) -> Cycle:
        # A cycle passes over its data several times; a batch is read from its source once.
        data = batch.persist(StorageLevel.MEMORY_AND_DISK) if source is None else source()
        try:
            return run_cycle(
                prepare(data), dataset_name, own, config, _held(own, rules), run_id=run_id,
                **cycle_options,
            )
        finally:
            if source is None:
                data.unpersist()

    writer = stream.writeStream.foreachBatch(cycle).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        minutes = config.schedule.interval_minutes
        writer = writer.trigger(processingTime=f"{minutes} minutes")
    return writer.start()
