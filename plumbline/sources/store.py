"""Run history, check results, anomalies and alerts as append-only Parquet tables.

Every table has two parts. A run appends to ``fresh``, one folder per run and dataset;
writing a run a second time (a replayed stream batch) replaces its folder. When ``FRESH``
runs have gathered, they are folded into one partition per dataset and month, sorted by
time, so the number of files follows the datasets and months and not the runs.

A manifest says which partitions hold. It is a small file that appears whole under the next
version number: a reader sees the history before a fold or after it, and of two folds at
once one gives way. What a fold replaces stays until the next one, for readers that still
use it. Rows of a run in ``fresh`` go before the folded ones, so rewriting a folded run
replaces it at once and for good at the next fold.

An index, folded like the tables, leads from a run's id to its partitions. Reading one run,
one dataset or the time since a moment opens the partitions concerned and lists no others.
The run record is written last, so a run that is listed is complete.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.findings import FINDINGS_SCHEMA
from plumbline.sources.files import Files
from plumbline.sources.pinning import pin

RUN = ["dataset_name", "run_id"]

#: Runs that may gather before they are folded.
FRESH = 256
#: Rows of a file at most.
FILE_ROWS = 1_000_000

RUNS = (
    "run_id string, dataset_name string, timestamp timestamp, quality_score double, "
    "rows bigint, columns int, metrics_file string, status string"
)
CHECK_RESULTS = (
    FINDINGS_SCHEMA + ", timestamp timestamp, dataset_name string, run_id string"
)
ANOMALIES = (
    "column_name string, mean double, std double, lower_bound double, "
    "upper_bound double, anomaly_count bigint, anomaly_percentage double, "
    "total_count bigint, timestamp timestamp, dataset_name string, run_id string"
)
ALERT_FIELDS = {
    "run_id": "string",
    "dataset_name": "string",
    "type": "string",
    "severity": "string",
    "message": "string",
    "timestamp": "timestamp",
    "column_name": "string",
    "value": "double",
    "threshold": "double",
    "anomaly_percentage": "double",
    "anomaly_count": "bigint",
    "actions": "array<string>",
}
ALERTS = ", ".join(f"{name} {kind}" for name, kind in ALERT_FIELDS.items())
OUTBOX = (
    ALERTS + ", channel string, recipients array<string>, subject string, "
    "body string, payload string"
)

TABLES = {
    "runs": RUNS,
    "check_results": CHECK_RESULTS,
    "anomalies": ANOMALIES,
    "alerts": ALERTS,
    "outbox": OUTBOX,
}
INDEX = "run_id string, dataset_name string, month string"


def tag(value: str) -> str:
    """A folder name for any name: no character of it needs care."""
    if not value:
        raise ValueError("dataset names and run ids must not be empty")
    return "h" + hashlib.md5(value.encode()).hexdigest()


def tagged(name: str) -> Column:
    return F.concat(F.lit("h"), F.md5(F.col(name).cast("binary")))


def month_of(stamp: str = "timestamp") -> Column:
    return F.coalesce(F.date_format(stamp, "yyyy-MM"), F.lit("0000-00"))


def first_month(since: datetime.datetime) -> str:
    """The month before which nothing is later than ``since``, in any time zone."""
    return f"{since - datetime.timedelta(days=1):%Y-%m}"


def new_run_id() -> str:
    return str(uuid.uuid4())


class RunStore:
    """Tables under one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, fresh: int = FRESH) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.fresh = fresh
        self.files = Files(spark, self.path)

    def table_path(self, table: str) -> str:
        return f"{self.path}/{table}"

    def run_path(self, table: str, dataset_name: str, run_id: str) -> str:
        return f"{self.table_path(table)}/fresh/run={tag(run_id)}/ds={tag(dataset_name)}"

    # ------------------------------------------------------------ manifest

    def _manifest(self) -> dict:
        """The latest version: folded partitions per table and the generation of each."""
        found = [n for n in self.files.names(f"{self.path}/manifest") if n.startswith("v")]
        if not found:
            return {"version": 0, "parts": {}, "retired": [], "settled": 0}
        return json.loads(self.files.read(f"{self.path}/manifest/{found[-1]}"))

    def _publish(self, manifest: dict) -> bool:
        name = f"{self.path}/manifest/v{manifest['version']:012d}"
        return self.files.publish(name, json.dumps(manifest))

    def _paths(self, manifest: dict, table: str, parts: Iterable[str]) -> list[str]:
        held = manifest["parts"].get(table, {})
        return [f"{self.table_path(table)}/folded/{held[p]}/{p}" for p in sorted(parts) if p in held]

    def _folded(self, manifest: dict, table: str, parts: Iterable[str] | None = None) -> DataFrame:
        """Folded rows with their partition columns; of all partitions, or of those named."""
        schema = INDEX + ", shard string" if table == "index" else TABLES[table] + ", ds string, month string"
        if parts is None:
            parts = manifest["parts"].get(table, {})
        frames = []
        for generation, paths in self._by_generation(manifest, table, parts).items():
            base = f"{self.table_path(table)}/folded/{generation}"
            frames.append(self.spark.read.schema(schema).option("basePath", base).parquet(*paths))
        if not frames:
            return self.spark.createDataFrame([], schema)
        found = frames[0]
        for other in frames[1:]:
            found = found.unionByName(other)
        return found

    def _by_generation(self, manifest: dict, table: str, parts: Iterable[str]) -> dict[str, list[str]]:
        held, found = manifest["parts"].get(table, {}), {}
        for part in sorted(parts):
            if part in held:
                path = f"{self.table_path(table)}/folded/{held[part]}/{part}"
                found.setdefault(held[part], []).append(path)
        return found

    # ------------------------------------------------------------ reading

    def read(
        self,
        table: str,
        dataset_name: str | None = None,
        since: datetime.datetime | None = None,
    ) -> DataFrame:
        """A table, or its rows of one dataset or later than a moment; empty if there are none."""
        new = self._fresh(table, f"{self.table_path(table)}/fresh")
        manifest = self._manifest()  # after the listing, so that a fold in between loses nothing
        old = self._folded(manifest, table, self._parts(manifest, table, dataset_name, since))
        if since is not None:
            old = old.filter(F.col("month") >= first_month(since))
        found = self._joined(old, new, table)
        if dataset_name is not None:
            found = found.filter(F.col("dataset_name") == dataset_name)
        if since is not None:
            found = found.filter(F.col("timestamp") > F.lit(since))
        return found

    def _parts(self, manifest: dict, table: str, dataset_name: str | None, since) -> list[str]:
        def wanted(part: str) -> bool:
            ds, month = (p.partition("=")[2] for p in part.split("/"))
            return (dataset_name is None or ds == tag(dataset_name)) and (
                since is None or month >= first_month(since)
            )

        return [p for p in manifest["parts"].get(table, {}) if wanted(p)]

    def _fresh(self, table: str, path: str) -> DataFrame | None:
        """Rows not folded yet below a path; None if nothing was written there."""
        if not self.files.exists(path):
            return None
        base = f"{self.table_path(table)}/fresh"
        schema = TABLES[table] + ", run string, ds string"
        found = self.spark.read.schema(schema).option("basePath", base).parquet(path)
        return found if found.inputFiles() else None

    def _written(self, fresh: DataFrame) -> DataFrame:
        """(run, ds) of all folders of fresh rows, also of those that hold no row.

        Bounded by twice the number of runs at which they are folded.
        """
        pairs = {tuple(p.partition("=")[2] for p in f.split("/")[-3:-1]) for f in fresh.inputFiles()}
        return self.spark.createDataFrame(sorted(pairs), "run string, ds string")

    def _joined(self, old: DataFrame, new: DataFrame | None, table: str) -> DataFrame:
        """Folded rows of runs that are not fresh, and the fresh rows."""
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        if new is None:
            return old.select(*columns)
        return _without(old, F.broadcast(self._written(new))).select(*columns).unionByName(new.select(*columns))

    def read_run(self, table: str, dataset_name: str, run_id: str) -> DataFrame:
        """One run's rows, without listing the folders of other runs."""
        return self.of_run(table, run_id, dataset_name)

    def of_run(self, table: str, run_id: str, dataset_name: str | None = None) -> DataFrame:
        """The rows under one run id, of one dataset or of all that have such a run."""
        path = f"{self.table_path(table)}/fresh/run={tag(run_id)}"
        if dataset_name is not None:
            path += f"/ds={tag(dataset_name)}"
        new = self._fresh(table, path)
        manifest = self._manifest()
        parts = [] if new is not None and dataset_name is not None else self._of_index(manifest, run_id)
        if dataset_name is not None:
            parts = [p for p in parts if p.startswith(f"ds={tag(dataset_name)}/")]
        found = self._joined(self._folded(manifest, table, parts), new, table)
        found = found.filter(F.col("run_id") == run_id)
        return found if dataset_name is None else found.filter(F.col("dataset_name") == dataset_name)

    def _of_index(self, manifest: dict, run_id: str) -> list[str]:
        """Partitions that hold a run: one shard of the index is read."""
        index = self._folded(manifest, "index", [f"shard={tag(run_id)[1]}"])
        found = index.filter(F.col("run_id") == run_id).select("dataset_name", "month").collect()
        return [f"ds={tag(r.dataset_name)}/month={r.month}" for r in found]

    def runs(self, dataset_name: str | None = None) -> DataFrame:
        return self.read("runs", dataset_name)

    def alerts(self, since: datetime.datetime | None = None) -> DataFrame:
        return self.read("alerts", since=since)

    def run_metrics(self, run_id: str, dataset_name: str | None = None) -> DataFrame:
        """Check results of one run; no rows if the run is unknown."""
        return self.of_run("check_results", run_id, dataset_name)

    def run_anomalies(self, run_id: str, dataset_name: str | None = None) -> DataFrame:
        return self.of_run("anomalies", run_id, dataset_name)

    def metrics_document(self, run_id: str, dataset_name: str | None = None) -> DataFrame:
        """(run_id, json): one document with the run's record and all its results."""
        results = (
            self.run_metrics(run_id, dataset_name)
            .groupBy("run_id")
            .agg(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "check_type",
                            "column_name",
                            "constraint",
                            "status",
                            F.to_json("metrics").alias("metrics"),
                            F.to_json("params").alias("params"),
                        )
                    )
                ).alias("found")
            )
        )
        checks = F.transform(
            "found",
            lambda r: F.struct(
                r["check_type"].alias("check_type"),
                r["column_name"].alias("column_name"),
                r["constraint"].alias("constraint"),
                r["status"].alias("status"),
                F.from_json(r["metrics"], "map<string,double>").alias("metrics"),
                F.from_json(r["params"], "map<string,string>").alias("params"),
            ),
        )
        record = self.of_run("runs", run_id, dataset_name)
        return record.join(results, "run_id").select(
            "run_id",
            F.to_json(
                F.struct(
                    "run_id",
                    "dataset_name",
                    "timestamp",
                    F.struct(
                        F.struct("rows", "columns").alias("dataset_info"),
                        checks.alias("quality_checks"),
                        F.col("quality_score").alias("overall_quality_score"),
                    ).alias("metrics"),
                )
            ).alias("json"),
        )

    # ------------------------------------------------------------ writing

    def write(
        self, table: str, rows: DataFrame, dataset_name: str, run_id: str
    ) -> None:
        """Write the rows of one run, replacing what that run wrote before."""
        named = rows.withColumns({"dataset_name": F.lit(dataset_name), "run_id": F.lit(run_id)})
        self._appended(
            self._laid_out(named, table).coalesce(1), self.run_path(table, dataset_name, run_id)
        )
        if table == "runs":
            self._fold_if_due()

    def _laid_out(self, rows: DataFrame, table: str) -> DataFrame:
        """The table's columns in order; missing ones are NULL."""
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        return rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            ]
        )

    def _appended(self, rows: DataFrame, path: str, *partitions: str) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic" if partitions else "static")
            .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            .partitionBy(*partitions)
            .parquet(path)
        )

    def replace_runs(self, table: str, rows: DataFrame) -> None:
        """Write rows of any runs; what these runs wrote before is replaced.

        Few runs are appended, one folder each; more than would be folded next are folded
        at once.
        """
        named = self._laid_out(rows, table)
        runs = named.select(*RUN)
        # the first rows usually tell, without a shuffle of all of them
        some = runs.limit(4 * self.fresh + 1).distinct().count() > self.fresh
        if some or runs.distinct().limit(self.fresh + 1).count() > self.fresh:
            while not self.fold({table: named}):
                pass
            return
        placed = named.withColumns({"run": tagged("run_id"), "ds": tagged("dataset_name")})
        self._appended(placed.repartition("run", "ds"), f"{self.table_path(table)}/fresh", "run", "ds")
        if table == "runs":
            self._fold_if_due()

    # ------------------------------------------------------------ folding

    def _fold_if_due(self) -> None:
        waiting = len(self.files.names(f"{self.table_path('runs')}/fresh"))
        if waiting - self._manifest()["settled"] >= self.fresh:
            self.fold()

    def fold(self, given: dict[str, DataFrame] | None = None) -> bool:
        """Moves fresh rows, or the rows given, into partitions by dataset and month.

        False if another fold was faster; its result holds and nothing is lost. Rows given
        go before what their runs have in ``fresh``, so that is folded first.
        """
        if given is not None and not self.fold():
            return self.fold(given)
        manifest = self._manifest()
        for path in manifest["retired"]:
            self.files.delete(path, self.path)
        new, taken, fresh = dict(given or {}), [], {}
        if given is None:
            for table in TABLES:
                rows = self._fresh(table, f"{self.table_path(table)}/fresh")
                if rows is not None:
                    new[table] = rows
                    taken += [unquote(f) for f in rows.inputFiles()]
                    fresh[table] = self._written(rows)
        if not new:
            return True
        settled = len(self.files.names(f"{self.table_path('runs')}/fresh")) if given is None else 0
        new = {t: self._laid_out(r, t).withColumns({"ds": tagged("dataset_name"), "month": month_of()})
               for t, r in new.items()}
        keys = pin(_union(r.select(*RUN, "month") for r in new.values()).distinct())
        shard = F.substring(tagged("run_id"), 2, 1).alias("shard")
        shards = [f"shard={r.shard}" for r in keys.select(shard).distinct().collect()]
        index = self._folded(manifest, "index", shards)
        # a run written again may have lain in another month
        before = index.join(keys.select(*RUN), RUN, "left_semi").select("dataset_name", "month")
        places = before.union(keys.select("dataset_name", "month")).distinct().collect()
        touched = [f"ds={tag(r.dataset_name)}/month={r.month}" for r in places]
        generation = f"g-{uuid.uuid4().hex}"
        parts = {t: dict(p) for t, p in manifest["parts"].items()}
        retired = list(taken)
        for table, rows in new.items():
            old = self._folded(manifest, table, touched)
            if table in fresh:
                left = _without(old, fresh[table])
            else:  # runs that are given have names, which need no digest
                left = old.join(rows.select(*RUN), RUN, "left_anti")
            both = rows.unionByName(left)
            written = self._write_folded(table, both, generation, ["ds", "month"], ["timestamp"])
            retired += self._replace(parts, table, touched, written, generation)
        entries = keys.select(*RUN, "month", shard).unionByName(index.join(keys, [*RUN, "month"], "left_anti"))
        written = self._write_folded("index", entries, generation, ["shard"], [])
        retired += self._replace(parts, "index", shards, written, generation)
        done = self._publish(
            {"version": manifest["version"] + 1, "parts": parts, "retired": retired, "settled": settled}
        )
        if done:
            for name in self.files.names(f"{self.path}/manifest")[:-2]:
                self.files.delete(f"{self.path}/manifest/{name}", self.path)
        else:
            for table in [*new, "index"]:
                self.files.delete(f"{self.table_path(table)}/folded/{generation}", self.path)
        return done

    def _write_folded(
        self, table: str, rows: DataFrame, generation: str, partitions: list[str], order: list[str]
    ) -> list[str]:
        """Writes partitions of a new generation, and says which there are."""
        path = f"{self.table_path(table)}/folded/{generation}"
        keys = [*partitions, *order, "run_id"]
        # rebalanced by size, so that a dataset with most of the rows is written by many tasks;
        # a partition by range would work out all rows twice, once for its bounds
        (
            rows.hint("rebalance", *[F.col(c) for c in partitions])
            .sortWithinPartitions(*keys)
            .write.option("maxRecordsPerFile", FILE_ROWS)
            .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            .partitionBy(*partitions)
            .parquet(path)
        )
        return self._leaves(path, len(partitions))

    def _leaves(self, path: str, depth: int) -> list[str]:
        found = [n for n in self.files.names(path) if "=" in n]
        if depth == 1:
            return found
        return [f"{n}/{leaf}" for n in found for leaf in self._leaves(f"{path}/{n}", depth - 1)]

    def _replace(self, parts: dict, table: str, touched: list[str], written: list[str], generation: str) -> list[str]:
        """Puts the new partitions in place of the touched ones; returns what is retired."""
        held, retired = parts.setdefault(table, {}), []
        for part in {*touched, *written}:
            if part in held:
                retired.append(f"{self.table_path(table)}/folded/{held.pop(part)}/{part}")
        held.update({part: generation for part in written})
        return retired

    # ------------------------------------------------------------ alerts, results

    def add_alerts(self, alerts: DataFrame) -> DataFrame:
        """Keep alerts, one per run, type and column, and return all of their runs.

        Adding the same alerts again changes nothing; other alerts of the same runs stay.
        Only the months of the alerts are read.
        """
        key = [*RUN, "type", "column_name"]
        new = pin(alerts)
        earliest = new.agg(F.min("timestamp")).first()[0]
        stored = self.read("alerts", since=earliest and earliest - datetime.timedelta(days=31))
        known = stored.join(new.select(*RUN).distinct(), RUN, "left_semi")
        both = known.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
        latest = Window.partitionBy(*key).orderBy("age")
        kept = pin(
            both.withColumn("place", F.row_number().over(latest))
            .filter("place = 1")
            .select(*ALERT_FIELDS)
        )
        self.replace_runs("alerts", kept)
        return kept

    def save_results(
        self,
        results: DataFrame,
        dataset_name: str,
        run_id: str,
        timestamp: datetime.datetime,
    ) -> None:
        rows = results.withColumn("timestamp", F.lit(timestamp).cast("timestamp"))
        self.write("check_results", rows, dataset_name, run_id)

    def save_anomalies(
        self,
        counts: DataFrame,
        dataset_name: str,
        run_id: str,
        timestamp: datetime.datetime,
    ) -> None:
        rows = counts.withColumn("timestamp", F.lit(timestamp).cast("timestamp"))
        self.write("anomalies", rows, dataset_name, run_id)

    def export_metrics(self, run_id: str, path: str, dataset_name: str | None = None) -> None:
        """Write the run's JSON document as a text file under ``path``."""
        (
            self.metrics_document(run_id, dataset_name)
            .select("json")
            .coalesce(1)
            .write.mode("overwrite")
            .text(path)
        )

    def clear_alerts(self) -> None:
        """Forgets all alerts; folded ones leave the manifest, their files go at the next fold."""
        while True:
            manifest = self._manifest()
            parts = {t: p for t, p in manifest["parts"].items() if t != "alerts"}
            gone = self._paths(manifest, "alerts", manifest["parts"].get("alerts", {}))
            if not gone or self._publish(
                {**manifest, "version": manifest["version"] + 1, "parts": parts,
                 "retired": manifest["retired"] + gone}
            ):
                break
        self.files.delete(f"{self.table_path('alerts')}/fresh", self.path)


def _without(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of no run in ``runs`` (run, ds)."""
    known = runs.select(F.col("run").alias("_run"), F.col("ds").alias("_ds"))
    return rows.join(known, (tagged("run_id") == F.col("_run")) & (F.col("ds") == F.col("_ds")), "left_anti")


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    found = frames[0]
    for other in frames[1:]:
        found = found.unionByName(other)
    return found
