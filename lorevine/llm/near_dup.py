"""Near-duplicate records with small edits: wildcard signatures over word-shingle vectors, verified, and joined into groups.

A record's shingle set is a sparse bit vector. Vectors are cut into segments, few enough that one segment of two similar records differs by at most one bit; segments and their one-wildcard variants are
indexed, screened for partners, joined on equality and verified exactly (``segments``). Copies with
equal shingle sets are folded first, so a text that occurs a million times costs as much as once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.functions.words import shingle_hashes, words
from lorevine.llm.components import components
from lorevine.llm.segments import similar_pairs
from lorevine.runtime import cut

#: Words per shingle, similarity and fewest words where a project states nothing else; ``note_details`` uses 3, 0.6 and 20.
WORDS, SIMILARITY, LEAST = 5, 0.8, 0


def shingled(records: DataFrame, key: str, text: list[str], k: int, least: int) -> DataFrame:
    """``(rec long, seq array<long>, tokens array<long>, content string)``: shingles in order, the distinct ones sorted, and a hash naming the set.

    Null texts count as empty; records with fewer than ``least`` (or ``k``) words and null keys are left out. Repeated rows stay.
    """
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text])
    out = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), words(joined).alias("w"))
    out = out.where(F.size("w") >= max(k, least)).select("rec", shingle_hashes(F.col("w"), k).alias("seq"))
    out = out.withColumn("tokens", F.sort_array(F.array_distinct("seq")))
    # 128 bits of two hashes with different seeds, and the size
    return out.withColumn("content", F.concat_ws("-", F.hex(F.xxhash64("tokens")), F.hex(F.xxhash64(F.lit(1), "tokens")), F.size("tokens").cast("string")))


def near_duplicates(records: DataFrame, key: str, text: list[str], k: int = WORDS, similarity: float = SIMILARITY, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members(rec, rep, group, links)`` for each record with a partner, ``links(a, b, jaccard)`` between representatives.

    ``rep`` is the smallest record with the same shingle set, ``group`` the smallest record of the group, ``links`` the record's direct partners. Two records are partners when the
    distinct shingles of both make up ``similarity`` of those of either; groups are joined through partners. Records too short, and those with
    no partner, do not occur. An empty table gives empty results; keys must be unique (repeated rows of a key with one text count once).
    """
    sets = cut(shingled(records, key, text, k, least).select("rec", "tokens", "content"), "shingled")
    classes = sets.groupBy("content").agg(F.min("rec").alias("rep"), F.countDistinct("rec").alias("copies"))
    members = cut(sets.select("rec", "content").distinct().join(classes, "content").select("rec", "rep", "copies"), "members")
    reps = cut(sets.join(members.where("rec = rep").select("rec"), "rec", "left_semi").groupBy("rec").agg(F.min_by("tokens", "content").alias("tokens")).select(F.col("rec").alias("id"), "tokens"), "reps")
    links = cut(similar_pairs(reps, similarity), "links")
    comps = components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    sizes = members.where("rec = rep").select(F.col("rep").alias("y"), "copies")
    degree = ends.join(sizes, "y").groupBy(F.col("x").alias("rep")).agg(F.sum("copies").alias("others"))
    out = members.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").join(degree, "rep", "left")
    out = out.select("rec", "rep", F.coalesce("comp", "rep").alias("group"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    return out, links.select("a", "b", "jaccard")


def group_pairs(members: DataFrame) -> DataFrame:
    """All pairs ``rec_a < rec_b`` within each group; only for results that ask for pairs, as they grow with the square of a group."""
    a, b = members.select(F.col("rec").alias("rec_a"), "group"), members.select(F.col("rec").alias("rec_b"), "group")
    return a.join(b, "group").where("rec_a < rec_b").select("rec_a", "rec_b").distinct()
