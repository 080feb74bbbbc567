"""All similar pairs between set-valued records, within one table or between two.

Pigeonhole partitioning of the token universe into length-dependent segments, joined on equal segments or one-deletion signatures and verified exactly;
see ``segments``. Equal sets are folded into classes before the join, so copies cost nothing; the result is pairs between class representatives plus membership, and
``all_pairs`` expands it where pairs of records are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorevine.functions.ids import normalize_id
from lorevine.llm.segments import similar_pairs
from lorevine.runtime import cut


def item_sets(records: DataFrame, key: str, items: Column, least: int = 1) -> DataFrame:
    """``(rec, items)``: the distinct, sorted, non-null items of each record that has at least ``least``; null keys and null arrays are left out."""
    out = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items"))
    return out.where(F.size("items") >= max(least, 1))


def note_items(tags: str = "tags", links: str = "wiki_links") -> Column:
    """The items of a note: tags trimmed, without leading ``#``, lower case; links as note ids; marked so that a tag never equals a link."""
    def tag(x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.trim(x), r"^#+", "")))

    empty = F.array().cast("array<string>")
    one = F.transform(F.filter(F.coalesce(F.col(tags), empty), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("t:"), tag(x)))
    two = F.transform(F.filter(F.coalesce(F.col(links), empty), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("l:"), normalize_id(x)))
    return F.concat(F.filter(one, lambda x: x != "t:"), two)


def similar_classes(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(members(rec, rep), pairs(rep_a, rep_b, jaccard))`` of ``sets(rec, items)``; ``rep`` is the smallest record with an equal set.

    A record given twice with different sets takes part with each under its smallest class.
    """
    hashed = sets.select("rec", F.transform("items", lambda x: F.xxhash64(x)).alias("tokens"), F.sha2(F.to_json(F.struct("items")), 256).alias("content"))
    hashed = cut(hashed, "items")
    classes = hashed.groupBy("content").agg(F.min("rec").alias("rep"), F.first("tokens").alias("tokens"))
    # one record may head several contents when keys repeat: classes get numbers of their own
    classes = cut(classes.withColumn("cls", F.xxhash64("content")), "classes")
    pairs = similar_pairs(classes.select(F.col("cls").alias("id"), "tokens"), similarity)
    members = hashed.select("rec", F.xxhash64("content").alias("cls")).distinct()
    named = classes.select("cls", "rep")
    out = pairs.join(named.select(F.col("cls").alias("a"), F.col("rep").alias("rep_a")), "a").join(named.select(F.col("cls").alias("b"), F.col("rep").alias("rep_b")), "b")
    return members.join(named, "cls").select("rec", "rep", "cls"), out.select("rep_a", "rep_b", F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "jaccard")


def all_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of records ``rec_a < rec_b`` whose sets reach ``similarity``; an empty table gives none."""
    members, pairs = similar_classes(sets, similarity)
    members, pairs = cut(members, "members"), cut(pairs, "pairs")
    m = members.select("rec", "cls")
    same = m.select(F.col("rec").alias("x"), "cls").join(m.select(F.col("rec").alias("y"), "cls"), "cls").where("x < y").select("x", "y")
    other = pairs.join(m.select(F.col("rec").alias("x"), F.col("cls").alias("cls_a")), "cls_a").join(m.select(F.col("rec").alias("y"), F.col("cls").alias("cls_b")), "cls_b").where("x <> y").select("x", "y")
    return same.unionByName(other).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def pairs_between(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """``(left_rec, right_rec)`` for sets of two tables: both go through one join, told apart by class membership."""
    both = left.select((F.col("rec") * 2).alias("rec"), "items").unionByName(right.select((F.col("rec") * 2 + 1).alias("rec"), "items"))
    members, pairs = similar_classes(both, similarity)
    members, pairs = cut(members, "members"), cut(pairs, "pairs")
    lefts = members.where("rec % 2 = 0").select((F.col("rec") / 2).cast("long").alias("left_rec"), "cls")
    rights = members.where("rec % 2 <> 0").select(((F.col("rec") - 1) / 2).cast("long").alias("right_rec"), "cls")
    ways = pairs.select("cls_a", "cls_b").unionByName(pairs.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    near = ways.join(lefts, ways.cls_a == lefts.cls).select("left_rec", "cls_b").join(rights.withColumnRenamed("cls", "cls_b"), "cls_b").select("left_rec", "right_rec")
    return near.unionByName(lefts.join(rights, "cls").select("left_rec", "right_rec")).distinct()
