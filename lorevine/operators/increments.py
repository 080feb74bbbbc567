"""Processing only new or changed records.

``IncrementStore`` keeps, per consumer, a directory of committed outputs and one manifest. A run fixes its upper bound (the highest commit
sequence present when it starts), reads the records with ``watermark < sequence <= upper``, writes its output beside the earlier ones, and
then publishes output and watermark together by renaming one manifest file into place. A run that dies before the rename leaves
only an unreferenced folder: the next run reads the same records again, and nothing is lost or counted twice. A run that dies after
the rename has been committed. Only the driver touches the manifest. A store has one writer at a time: a second one is found out by the watermark it read, and where renaming
refuses an existing target (HDFS) also in the moment of committing; on other file systems writers must take turns.

Records that arrive late carry a higher sequence than the watermark, however old their own timestamps are, so they are picked up.

``run`` adds an output for each window; ``fold`` keeps one state, which each window replaces (folders of earlier states stay, unreferenced).
``next_pending`` folds the latest change per note id and judges all of that state, so a run after the first has what the whole log would give.

Defined results: a null sequence is no committed record and is read by no run; an empty log leaves the watermark where it was; repeated
rows are handed on as they are (``latest_changes`` folds them); extra columns pass through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """The half-open range of commit sequences of one run."""

    low: int | None
    high: int | None

    def rows(self, log: DataFrame, sequence: str) -> DataFrame:
        """The rows of ``log`` in this range; the filter reaches the scan."""
        if self.high is None:
            return log.where(F.lit(False))
        inside = F.col(sequence) <= F.lit(self.high)
        return log.where(inside if self.low is None else inside & (F.col(sequence) > F.lit(self.low)))


class IncrementStore:
    """Committed outputs of an incremental consumer and the watermark they were made under."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    def _versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The newest manifest: version, watermark, committed output folders."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "watermark": None, "outputs": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def watermark(self) -> int | None:
        return self.state()["watermark"]

    def window(self, log: DataFrame, sequence: str, upto: int | None = None) -> Window:
        """From the committed watermark to the highest sequence that the log holds now, or the highest up to ``upto``."""
        low = self.watermark()
        high = (log if upto is None else log.where(F.col(sequence) <= F.lit(upto))).agg(F.max(sequence)).first()[0]
        return Window(low, high if high is not None and (low is None or high > low) else None)

    def commit(self, output: DataFrame, window: Window, replace: bool = False) -> str | None:
        """Write ``output`` and publish it together with the new watermark; an empty window commits nothing."""
        if window.high is None:
            return None
        self._expect(window)
        folder = f"{self.path}/outputs/{uuid.uuid4().hex}"
        output.write.parquet(folder)
        return self.publish(folder, window, replace)

    def _expect(self, window: Window) -> dict:
        state = self.state()
        if state["watermark"] != window.low:
            raise RuntimeError(f"another run has moved the watermark from {window.low} to {state['watermark']}")
        return state

    def publish(self, folder: str, window: Window, replace: bool = False) -> str:
        """Make a folder that is already written an output, or with ``replace`` the only one, together with the new watermark."""
        state = self._expect(window)
        state = {"version": state["version"] + 1, "watermark": window.high, "outputs": [folder] if replace else [*state["outputs"], folder]}
        draft = self._path(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(json.dumps(state).encode())
        stream.close()
        final = self._path(f"{self.path}/manifests/{state['version']}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} was committed by another run")
        return folder

    def run(self, log: DataFrame, sequence: str, step: Callable[[DataFrame], DataFrame]) -> str | None:
        """One whole run of ``step`` over the new rows."""
        window = self.window(log, sequence)
        return None if window.high is None else self.commit(step(window.rows(log, sequence)), window)

    def fold(self, log: DataFrame, sequence: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema, upto: int | None = None) -> DataFrame:
        """One whole run of ``step`` over the committed state and the new rows, which gives the state that replaces it; the state then committed."""
        window = self.window(log, sequence, upto)
        if window.high is not None:
            self.commit(step(self.outputs(schema), window.rows(log, sequence)), window, replace=True)
        return self.outputs(schema)

    def outputs(self, schema) -> DataFrame:
        """All committed outputs."""
        folders = self.state()["outputs"]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


#: Columns of ``latest_changes``.
LATEST = "id string, op string, modified_ms long, change_id long"


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change per note id: largest ``modified_ms`` (null lowest), then largest ``change_id``; null ids are left out.

    Folding a result again, with further changes or without, gives the last change of all.
    """
    key = F.struct(F.col("modified_ms"), F.col("change_id"))
    return changes.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by(F.upper(F.trim("op")), key).alias("op"), F.max("modified_ms").alias("modified_ms"), F.max_by("change_id", key).alias("change_id"))


def valid_entries(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Per note id the largest ``last_modified`` of entries written by runs with status ``ok``, nulls and zeros left out."""
    ok = runs.where(F.col("status") == "ok").select("run_id").distinct()
    usable = entries.where(F.col("last_modified").isNotNull() & (F.col("last_modified") != 0) & F.col("id").isNotNull())
    return usable.select("id", "last_modified", "run_id").join(ok, "run_id", "left_semi").groupBy("id").agg(F.max("last_modified").alias("indexed_ms"))


def pending_ids(changes: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Note ids of ``changes``, a whole log, that still have to be handled, given what successful runs have left in ``entries``.

    A deleted note is pending while a valid entry exists; another one while none exists or the newest one is older than the last change.
    The test is against what was committed, so a note whose run failed stays pending, and one handled already is not done again.
    """
    return _judged(latest_changes(changes), entries, runs)


def next_pending(store: IncrementStore, changes: DataFrame, entries: DataFrame, runs: DataFrame, upto: int | None = None) -> DataFrame:
    """The same ids from the new rows of ``changes`` and the latest change per id that earlier runs have committed; commits the latter anew.

    The whole state is judged, also when no row is new: entries and runs change without the log.
    """
    last = store.fold(changes, "change_id", lambda old, new: latest_changes(old.unionByName(new.select(old.columns))), LATEST, upto)
    return _judged(last, entries, runs)


def _judged(last: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    done = valid_entries(entries, runs)
    gone = F.col("op") == "DELETE"
    indexed = F.col("indexed_ms")
    open_ = F.when(gone, indexed.isNotNull()).otherwise(indexed.isNull() | (indexed < F.col("modified_ms")))
    return last.join(done, "id", "left").where(open_).select("id")
