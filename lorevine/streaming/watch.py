"""Keeping a collection of notes fresh from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorevine.operators.mutate import merge
from lorevine.sources.notes import Snapshot

CHANGES = "change_id bigint, id string, op string, modified_ms bigint, content string, arrived_at timestamp"


def read_changes(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of change records from a folder of Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sessions(changes: DataFrame, gap: str = "500 milliseconds", late: str = "1 hour") -> DataFrame:
    """Changes of an id with gaps below ``gap`` as one session; later than ``late`` they are dropped by the watermark."""
    return changes.withWatermark("arrived_at", late).groupBy(F.session_window("arrived_at", gap), "id").agg(F.count("*").alias("changes"), F.max("modified_ms").alias("modified_ms"))


def apply_batch(snapshot: Snapshot, batch: DataFrame) -> None:
    """Fold one micro-batch into the snapshot of ``(id, deleted, modified_ms, content)``: the last change of an id holds, unless the snapshot's is newer.

    A deleted note stays as a row without content, so that a change that comes late does not bring it back; ``live`` gives the others. Applying a batch again changes nothing, so a restarted stream repeats none.
    """
    key = F.struct("modified_ms", "change_id")
    last = batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.upper(F.trim("op")), key).alias("op"), F.max("modified_ms").alias("modified_ms"), F.max_by("content", key).alias("content"))
    gone = F.coalesce(F.col("op") == "DELETE", F.lit(False))
    last = last.select("id", gone.alias("deleted"), "modified_ms", F.when(~gone, F.col("content")).alias("content"))
    old = snapshot.read()
    if old is None:
        snapshot.publish(last)
        return
    newer = last.join(old.select("id", F.col("modified_ms").alias("old_ms")), "id", "left").where("old_ms IS NULL OR modified_ms >= old_ms").drop("old_ms")
    snapshot.publish(merge(old, newer, newer.select("id").limit(0)))


def live(snapshot: Snapshot) -> DataFrame | None:
    """``(id, modified_ms, content)`` of the notes that are not deleted."""
    state = snapshot.read()
    return None if state is None else state.where("NOT deleted").drop("deleted")


def watch(changes: DataFrame, snapshot: Snapshot, checkpoint: str, notify: Callable[[int], None] | None = None, once: bool = False) -> StreamingQuery:
    """Run ``apply_batch`` for every micro-batch; ``notify`` is told each version published."""
    def step(batch: DataFrame, _: int) -> None:
        apply_batch(snapshot, batch)
        if notify:
            notify(snapshot.version())

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
