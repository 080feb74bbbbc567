"""Connected components over link tables, by min-label propagation with pointer jumping; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.runtime import cut, discard


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the links; equal from one round to the next only when none has moved."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node of the undirected ``links``; ``comp`` is the smallest node of its component.

    Alternates large-star and small-star steps, each one shuffle on the node with map-side minima, until no link changes; every round is written to the
    shared folder. Null ends and self-links are ignored; a node with no other link does not occur; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    edges = cut(edges, "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("n"), F.least("m", "hi").alias("m"))
        # large star: every larger neighbour of a node is linked to the least of its neighbourhood
        large = edges.select(F.col("lo").alias("n"), F.col("hi").alias("x")).join(least, "n").select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        # small star: every smaller neighbour, and the node itself, is linked to the least
        moved = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        last, edges = edges, cut(moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(last)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
