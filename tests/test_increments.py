"""Incremental runs, snapshots and streams."""

import pytest
from pyspark.sql import functions as F

from lorevine.operators.increments import IncrementStore, next_pending, pending_ids
from lorevine.operators.mutate import debounced
from lorevine.sources.notes import Snapshot
from lorevine.streaming.watch import CHANGES, live, read_changes, sessions, watch
from tests.compare import DATA

LOG = "change_id long, id string, op string, modified_ms long"


def test_watermark(spark, tmp_path):
    store = IncrementStore(spark, f"file://{tmp_path}/s")
    step = lambda new: new.select("change_id", "id")
    log = spark.createDataFrame([(1, "a", "CREATE", 5), (2, "b", "CREATE", 6), (None, "z", "CREATE", 1)], LOG)
    assert store.run(log.limit(0), "change_id", step) is None and store.watermark() is None
    store.run(log, "change_id", step)
    assert store.watermark() == 2
    assert store.run(log, "change_id", step) is None
    # late by its own time, but committed later
    more = log.unionByName(spark.createDataFrame([(3, "c", "MODIFY", 1)], LOG))

    def fails(new):
        return step(new).withColumn("x", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception):
        store.run(more, "change_id", fails)
    assert store.watermark() == 2
    store.run(more, "change_id", step)
    assert sorted(r.change_id for r in store.outputs("change_id long, id string").collect()) == [1, 2, 3]


def test_bound_is_fixed_at_start(spark, tmp_path):
    store = IncrementStore(spark, f"file://{tmp_path}/s")
    log = spark.createDataFrame([(1, "a", "CREATE", 5)], LOG)
    window = store.window(log, "change_id")
    grown = log.unionByName(spark.createDataFrame([(2, "b", "CREATE", 5)], LOG))
    assert window.rows(grown, "change_id").count() == 1
    store.commit(window.rows(grown, "change_id"), window)
    with pytest.raises(RuntimeError):
        store.commit(grown, window)


def test_pending(spark):
    changes = spark.createDataFrame([(1, "done", "create", 5), (2, "stale", " Modify ", 9), (3, "new", "CREATE", 1), (4, "gone", "CREATE", 1), (5, "gone", "DELETE", 2), (6, "never", "DELETE", 2), (7, "failed", "CREATE", 1), (8, None, "CREATE", 1), (1, "done", "create", 5)], LOG)
    entries = spark.createDataFrame([("done", 5, 1), ("stale", 8, 1), ("gone", 1, 1), ("failed", 9, 2), ("new", 0, 1), ("new", None, 1)], "id string, last_modified long, run_id long")
    runs = spark.createDataFrame([(1, "ok", "x"), (2, "failed", "y"), (3, None, "z")], "run_id long, status string, id string")
    assert sorted(r.id for r in pending_ids(changes, entries, runs).collect()) == ["failed", "gone", "new", "stale"]
    assert pending_ids(changes.limit(0), entries, runs).count() == 0


def test_pending_over_windows(spark, tmp_path):
    log = [(1, "failed", "CREATE", 1), (2, "late", "CREATE", 9), (3, "gone", "DELETE", 9), (4, "lost", "CREATE", 1), (5, "fresh", "CREATE", 1)]
    more = [(6, "late", "DELETE", 4), (7, "gone", "MODIFY", 4), (8, "fresh", "MODIFY", 7), (9, None, "CREATE", 1)]
    entries = spark.createDataFrame([("failed", 1, 2), ("late", 9, 1), ("lost", 1, 3), ("fresh", 1, 1)], "id string, last_modified long, run_id long")
    runs = lambda *ok: spark.createDataFrame([(r, "ok" if r in ok else "failed") for r in (1, 2, 3)], "run_id long, status string")
    store = IncrementStore(spark, f"file://{tmp_path}/s")

    def ask(rows, ok):
        return sorted(r.id for r in next_pending(store, spark.createDataFrame(rows, LOG), entries, ok).collect())

    assert ask(log, runs(1, 3)) == ["failed"]
    # late rows do not outrank what was consumed; the note of the failed run has no new row
    assert ask(log + more, runs(1, 3)) == ["failed", "fresh"]
    # no new rows: one run was repaired, another one turned out to have failed
    assert ask(log + more, runs(1, 2)) == ["fresh", "lost"]
    # a run that dies before its commit changes nothing
    with pytest.raises(Exception):
        store.fold(spark.createDataFrame([*log, *more, (10, "x", "CREATE", 1)], LOG), "change_id", lambda old, new: old.select(F.raise_error(F.lit("lost")).alias("id")), "id string")
    assert store.watermark() == 9 and ask([*log, *more, (10, "x", "CREATE", 1)], runs(1, 2)) == ["fresh", "lost", "x"]


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_pending_windows_of_tables(spark, tmp_path):
    changes, entries, runs = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("note_changes", "cache_entries", "index_runs"))
    store, last = IncrementStore(spark, f"file://{tmp_path}/s"), changes.agg(F.max("change_id")).first()[0]
    for part in (1, 2, 3):
        seen = changes.where(F.col("change_id") <= last * part // 3)
        assert sorted(next_pending(store, seen, entries, runs).collect()) == sorted(pending_ids(seen, entries, runs).collect())


def test_debounce(spark):
    e = spark.createDataFrame([("a", 0), ("a", 400), ("a", 900), ("b", 0), (None, 3), ("a", None)], "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {(r.k, r.session): r.events for r in debounced(e, "k", "ts", 500).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("b", 1): 1}


def test_stream(spark, tmp_path):
    folder, told = f"{tmp_path}/in", []
    snapshot = Snapshot(spark, f"file://{tmp_path}/snap")
    rows = [(1, "a", "CREATE", 1, "x"), (2, "b", "create", 1, "y"), (3, "a", "MODIFY", 2, "z")]
    frame = lambda r: spark.createDataFrame(r, "change_id long, id string, op string, modified_ms long, content string").withColumn("arrived_at", F.timestamp_millis(F.col("modified_ms"))).coalesce(1)
    frame(rows).write.parquet(folder)
    for more in ([], [(4, "b", "DELETE", 5, None), (5, "a", "MODIFY", 1, "late")], [(6, "b", " modify ", 3, "too late"), (7, "c", " delete", 9, None)]):
        if more:
            frame(more).write.mode("append").parquet(folder)
        q = watch(read_changes(spark, folder), snapshot, f"{tmp_path}/cp", told.append, once=True)
        q.awaitTermination(60)
    assert [(r.id, r.content) for r in live(snapshot).collect()] == [("a", "z")]
    assert {(r.id, r.deleted, r.modified_ms) for r in snapshot.read().collect()} == {("a", False, 2), ("b", True, 5), ("c", True, 9)}
    assert told == [1, 2, 3]
    s = sessions(spark.readStream.schema(CHANGES).parquet(folder))
    assert s.isStreaming and "session_window" in s.columns
