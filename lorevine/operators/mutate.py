"""Changes to a collection of notes, as new DataFrames: upsert, delete, importance, incremental merges, snapshot differences, session debouncing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorevine.functions.ids import normalize_id
from lorevine.functions.markdown import set_frontmatter


def merge(old: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Old notes without the changed and removed ones, and the changed ones."""
    gone = changed.select("id").unionByName(removed.select("id")).distinct()
    return old.join(gone, "id", "left_anti").unionByName(changed)


def create(notes: DataFrame, new: DataFrame) -> DataFrame:
    """``notes`` and the notes of ``new``, their ids normalised; an id that exists already (or twice in ``new``) is an error."""
    named = new.withColumn("id", normalize_id(F.col("id")))
    if named.groupBy("id").count().where("count > 1").limit(1).count() or named.join(notes.select("id"), "id", "left_semi").limit(1).count():
        raise ValueError("a note with this id exists")
    return notes.unionByName(named)


def update(notes: DataFrame, changed: DataFrame) -> DataFrame:
    """``notes`` with the rows of ``changed`` in place of theirs; an unknown id is an error."""
    if changed.join(notes.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("no note with this id")
    return merge(notes, changed, changed.select("id").limit(0))


def delete(notes: DataFrame, note_id: str) -> DataFrame:
    """``notes`` without one; an unknown id is an error."""
    if not notes.where(F.col("id") == note_id).limit(1).count():
        raise ValueError("no note with this id")
    return notes.where(F.col("id") != note_id)


def set_importance(notes: DataFrame, note_id: str, importance: int) -> DataFrame:
    """The clamped importance in the column and in the front matter of one note."""
    value = max(0, min(10, importance))
    hit = F.col("id") == note_id
    return notes.withColumn("content", F.when(hit, set_frontmatter(F.col("content"), "importance", F.lit(value))).otherwise(F.col("content"))).withColumn("importance", F.when(hit, F.lit(value)).otherwise(F.col("importance")))


def modified(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids of ``files(id, modified_ms)`` that ``cache(id, modified_ms)`` does not know or knows in an older state."""
    known = cache.groupBy("id").agg(F.max("modified_ms").alias("cached_ms"))
    return files.join(known, "id", "left").where(F.col("cached_ms").isNull() | (F.col("cached_ms") < F.col("modified_ms"))).select("id").distinct()


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, op)``: what was created, modified or deleted between two snapshots ``(id, modified_ms, content)``; ids are unique in each."""
    a = before.select("id", F.col("modified_ms").alias("m1"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("h1"), F.lit(1).alias("x"))
    b = after.select("id", F.col("modified_ms").alias("m2"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("h2"), F.lit(1).alias("y"))
    op = F.when(F.col("x").isNull(), F.lit("CREATE")).when(F.col("y").isNull(), F.lit("DELETE")).when(~F.col("m1").eqNullSafe(F.col("m2")) | (F.col("h1") != F.col("h2")), F.lit("MODIFY"))
    return a.join(b, "id", "full_outer").select("id", op.alias("op")).where("op IS NOT NULL")


def debounced(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """``(key, session, first, last, events)``: events of a key whose gaps are below ``gap_ms`` form one session.

    Sessions are split with a window over the key's events; nulls in key or time are left out.
    """
    w = Window.partitionBy(key).orderBy("_ms")
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.unix_millis(F.col(ts).cast("timestamp_ltz")).alias("_ms"))
    marked = rows.withColumn("_new", F.coalesce((F.col("_ms") - F.lag("_ms").over(w) >= gap_ms).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"), F.count("*").alias("events"))


def autolinks(explicit: DataFrame, hits: DataFrame, least: float = 0.3) -> DataFrame:
    """``explicit(id, links)`` with links found for it in ``hits(id, other, score, rank)``: ``(id, all_links, new_links)``.

    Hits below ``least`` and of the note itself do not count; given links come first, each once.
    """
    good = hits.where((F.col("score") >= least) & (F.col("other") != F.col("id")))
    found = good.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("found"))
    empty = F.array().cast("array<string>")
    both = explicit.join(found, "id", "left").select("id", F.coalesce("links", empty).alias("links"), F.coalesce("found", empty).alias("found"))
    return both.select("id", F.array_distinct(F.concat("links", "found")).alias("all_links"), F.array_distinct(F.array_except("found", "links")).alias("new_links"))
