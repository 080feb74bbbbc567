"""Queries of the general data-pipeline problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.operators.increments import IncrementStore, next_pending
from lorevine.runtime import scratch, table


#: Runs in which ``p3_found`` takes the log.
RUNS = 3


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids the next indexing run has to handle, after the log has come in three runs: each reads only the rows above the watermark and folds them into the latest changes committed before."""
    changes, entries, runs = (table(spark, sf_dir, t) for t in ("note_changes", "cache_entries", "index_runs"))
    store = IncrementStore(spark, scratch(spark, "pending"))
    low, high = changes.agg(F.min("change_id"), F.max("change_id")).first()
    for i in range(1, RUNS):
        if low is not None:
            next_pending(store, changes, entries, runs, low + (high - low) * i // RUNS)
    return next_pending(store, changes, entries, runs)


def p3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the three runs reads: bounds of its window, rows and note ids in it."""
    changes = table(spark, sf_dir, "note_changes")
    store = IncrementStore(spark, scratch(spark, "windows"))
    low, high = changes.agg(F.min("change_id"), F.max("change_id")).first()
    step = lambda rows: rows.agg(F.min("change_id").alias("first_id"), F.max("change_id").alias("last_id"), F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))
    for i in range(1, RUNS + 1):
        window = store.window(changes, "change_id", None if low is None else low + (high - low) * i // RUNS)
        store.commit(step(window.rows(changes, "change_id")), window)
    return store.outputs("first_id long, last_id long, n_rows long, n_ids long")


QUERIES = {"p3_found": p3_found, "p3_windows": p3_windows}

ORACLES = {
    "p3_found": """
WITH latest AS (SELECT id, upper(trim(op)) AS op, modified_ms FROM note_changes WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_ms DESC NULLS LAST, change_id DESC) = 1),
done AS (SELECT id, max(last_modified) AS ms FROM cache_entries WHERE last_modified IS NOT NULL AND last_modified <> 0
    AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok') GROUP BY id)
SELECT l.id FROM latest l LEFT JOIN done d ON l.id = d.id
WHERE CASE WHEN l.op = 'DELETE' THEN d.ms IS NOT NULL ELSE d.ms IS NULL OR d.ms < l.modified_ms END""",
    "p3_windows": """
WITH b AS (SELECT min(change_id) AS lo, max(change_id) AS hi FROM note_changes), w AS (SELECT c.*, CASE WHEN change_id <= lo + (hi - lo) // 3 THEN 1 WHEN change_id <= lo + (hi - lo) * 2 // 3 THEN 2 ELSE 3 END AS run FROM note_changes c, b WHERE change_id IS NOT NULL)
SELECT min(change_id) AS first_id, max(change_id) AS last_id, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM w GROUP BY run""",
}
