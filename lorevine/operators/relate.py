"""The relationship graph of notes: weighted, typed, undirected edges from links, shared tags and shared keywords.

Notes meet only inside the bucket of a tag or keyword, and buckets of one note or of more than ``MAX_BUCKET`` are no signal, so the pairs of a bucket
are bounded. Pairs are counted with map-side partial sums on surrogate numbers; string ids come back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BUCKET = 500
LINK_WEIGHT, TAG_WEIGHT, KEYWORD_WEIGHT = 5, 2, 1
TAG_CAP, KEYWORD_CAP = 3, 5
#: Relation types where no note declares one, by the strongest signal.
RELATIONS = (("wiki_link", "references"), ("shared_tags", "related_topic"), ("shared_keywords", "similar_content"))


def bucket_pairs(notes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``(a, b, n)`` with ``a < b``: how many values of ``column`` two notes share, counting buckets of 2 to ``MAX_BUCKET`` notes."""
    terms = notes.select(F.col(key).alias("a"), F.explode(F.array_distinct(column)).alias("term")).where(F.col("term").isNotNull())
    sizes = terms.groupBy("term").agg(F.count("*").alias("size")).where(F.col("size").between(2, MAX_BUCKET)).select("term")
    kept = terms.join(sizes, "term")
    # both sides come from one exchange on the term; a bucket gives at most MAX_BUCKET squared pairs
    return kept.join(kept.select(F.col("a").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def resolved_links(notes: DataFrame) -> DataFrame:
    """``(src, dst)`` for every distinct link to a note that exists."""
    links = notes.select(F.col("id").alias("src"), F.explode(F.array_distinct("wiki_links")).alias("dst"))
    return links.join(notes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def dangling_links(notes: DataFrame) -> DataFrame:
    """``(src, dst)`` for every distinct link that leads nowhere."""
    links = notes.select(F.col("id").alias("src"), F.explode(F.array_distinct("wiki_links")).alias("dst"))
    return links.where(F.col("dst").isNotNull()).join(notes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def inferred_type(reasons: Column) -> Column:
    """The relation type that the reasons give."""
    out = F.lit("related")
    for reason, kind in reversed(RELATIONS):
        out = F.when(F.array_contains(reasons, reason), F.lit(kind)).otherwise(out)
    return out


def build_edges(notes: DataFrame) -> DataFrame:
    """``(source, target, weight, reasons, relation_type)`` with ``source <= target``; a note that links to itself has an edge to itself.

    Weight: 5 for each direction linked, 2 for each shared tag up to 3, 1 for each shared keyword up to 5. The type is that
    declared by the note first in ``ord``, else inferred. ``ord`` numbers the notes: it is what pairs are shuffled by, and must be unique.
    """
    numbers = notes.select("ord", "id")
    targets = numbers.select(F.col("ord").alias("to"), F.col("id").alias("dst"))
    linked = notes.select("ord", F.explode(F.array_distinct("wiki_links")).alias("dst")).join(targets, "dst")
    pair = (F.least("ord", "to").alias("a"), F.greatest("ord", "to").alias("b"))
    zero = F.lit(0).cast("long")
    signals = (
        linked.groupBy(*pair).agg(F.count("*").alias("links")).select("a", "b", "links", zero.alias("tags"), zero.alias("words"))
        .unionByName(bucket_pairs(notes, "tags", "ord").select("a", "b", zero.alias("links"), F.col("n").alias("tags"), zero.alias("words")))
        .unionByName(bucket_pairs(notes, "keywords", "ord").select("a", "b", zero.alias("links"), zero.alias("tags"), F.col("n").alias("words"))))
    summed = signals.groupBy("a", "b").agg(F.sum("links").alias("links"), F.sum("tags").alias("tags"), F.sum("words").alias("words"))
    typed = notes.select("ord", "id", F.explode("wiki_link_types").alias("dst", "type")).where(F.trim("type") != "").join(targets, "dst")
    declared = typed.groupBy(*pair).agg(F.min_by("type", F.struct("ord", "id", "dst")).alias("declared"))
    weight = LINK_WEIGHT * F.col("links") + TAG_WEIGHT * F.least(F.lit(TAG_CAP), F.col("tags")) + KEYWORD_WEIGHT * F.least(F.lit(KEYWORD_CAP), F.col("words"))
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("links") > 0, F.lit("wiki_link")), F.when(F.col("tags") > 0, F.lit("shared_tags")), F.when(F.col("words") > 0, F.lit("shared_keywords")))))
    inferred = inferred_type(F.col("reasons"))
    out = summed.join(declared, ["a", "b"], "left").withColumn("reasons", reasons).select(
        "a", "b", weight.cast("int").alias("weight"), "reasons", F.when(F.col("links") > 0, F.coalesce("declared", inferred)).otherwise(inferred).alias("relation_type")).where("weight > 0")
    named = out.join(numbers.select(F.col("ord").alias("a"), F.col("id").alias("x")), "a").join(numbers.select(F.col("ord").alias("b"), F.col("id").alias("y")), "b")
    return named.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), "weight", "reasons", "relation_type")
