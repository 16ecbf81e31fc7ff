"""Micro-batches that could not be measured, kept until they are.

A failed batch leaves its rows, as they came, and a letter with the error and the number of
tries. Replaying a letter runs the same cycle under the same run id, so it replaces the run
that failed; the letter goes once the run is stored. A crash in between repeats the replay,
which again replaces one run: a batch is measured once, however often it is tried.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.sources.store import RunStore, tag

LETTERS = "run_id string, dataset_name string, error string, tries int, failed_at timestamp"


@dataclass(frozen=True)
class Letter:
    run_id: str
    dataset_name: str
    error: str
    tries: int
    failed_at: str


class DeadLetters:
    """The failed batches of one dataset, in its store."""

    def __init__(self, store: RunStore, dataset_name: str) -> None:
        self.store, self.dataset_name = store, dataset_name
        self.path = f"{store.path}/dead_letters/{tag(dataset_name)}"

    def _folder(self, run_id: str) -> str:
        return f"{self.path}/{tag(run_id)}"

    def letters(self) -> list[Letter]:
        """The newest letter of every batch that is still to be measured, oldest batch first."""
        files, found = self.store.files, []
        for batch in files.names(self.path):
            written = [n for n in files.names(f"{self.path}/{batch}") if n.startswith("try-")]
            if written:
                found.append(Letter(**json.loads(files.read(f"{self.path}/{batch}/{written[-1]}"))))
        return sorted(found, key=lambda letter: letter.run_id)

    def table(self) -> DataFrame:
        rows = [
            (x.run_id, x.dataset_name, x.error, x.tries, datetime.datetime.fromisoformat(x.failed_at))
            for x in self.letters()
        ]
        return self.store.spark.createDataFrame(rows, LETTERS)

    def put(self, run_id: str, batch: DataFrame | None, error: Exception) -> None:
        """Notes a failure; the rows are written with the first one."""
        said = (str(error).strip().splitlines() or [type(error).__name__])[0]
        earlier = [x.tries for x in self.letters() if x.run_id == run_id]
        tries = earlier[0] + 1 if earlier else 1
        if batch is not None:
            batch.write.mode("overwrite").parquet(f"{self._folder(run_id)}/rows")
        now = datetime.datetime.now().isoformat()
        letter = Letter(run_id, self.dataset_name, said, tries, now)
        self.store.files.publish(
            f"{self._folder(run_id)}/try-{tries:06d}.json", json.dumps(letter.__dict__)
        )

    def rows(self, letter: Letter) -> DataFrame:
        return self.store.spark.read.parquet(f"{self._folder(letter.run_id)}/rows")

    def settle(self, letter: Letter) -> None:
        self.store.files.delete(self._folder(letter.run_id), self.store.path)
