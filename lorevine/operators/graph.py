"""Queries over the note graph: adjacency, degrees, bounded breadth-first traversal, shortest paths, neighbourhood context.

Traversals run one join per level and write each level to the shared folder, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorevine.runtime import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both ends; an edge of a note to itself occurs twice."""
    return _both_ways(edges, True)


def _both_ways(edges: DataFrame, loops_twice: bool) -> DataFrame:
    """Both directions of every edge from one pass over ``edges``."""
    there = F.struct(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = F.struct(F.col("target").alias("src"), F.col("source").alias("dst"))
    ends = F.array(there, back) if loops_twice else F.when(F.col("source") == F.col("target"), F.array(there)).otherwise(F.array(there, back))
    return edges.select(F.explode(ends).alias("e"), "weight", "reasons", "relation_type").select("e.src", "e.dst", "weight", "reasons", "relation_type")


def degrees(notes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """``(id, degree)`` of all notes; an edge to itself counts twice."""
    counted = adjacent.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return notes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def backlinks(adjacent: DataFrame) -> DataFrame:
    """``(id, neighbour)``: distinct neighbours by any signal, in either direction."""
    return adjacent.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()


def traverse(adjacent: DataFrame, start: str, depth: int, max_neighbors: int, min_weight: int) -> DataFrame:
    """``(id, depth, rank)`` in order of discovery, without the start.

    Each note opens its ``max_neighbors`` heaviest edges of at least ``min_weight`` (ties by id), visited neighbours using up places; a note is found by
    the first that opens it. Unknown start or depth below 1: empty.
    """
    spark = adjacent.sparkSession
    usable = adjacent.where(F.col("weight") >= min_weight)
    place = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst"))
    frontier = spark.createDataFrame([(start, 0, 0)], "id string, depth int, rank long")
    visited = frontier
    for level in range(1, depth + 1):
        opened = usable.join(frontier.select(F.col("id").alias("src"), F.col("rank").alias("parent")), "src")
        opened = opened.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max_neighbors)
        new = opened.select(F.col("dst").alias("id"), "parent", "place").join(visited.select("id"), "id", "left_anti")
        first = new.groupBy("id").agg(F.min(F.struct("parent", "place")).alias("at"))
        # a level is bounded by its parents times max_neighbors; ranks need one order over it
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("at")).cast("long"))
        frontier = cut(ranked.select("id", F.lit(level).alias("depth"), "rank"), "level")
        visited = cut(visited.unionByName(frontier), "visited")
        if not frontier.limit(1).count():
            break
    return visited.where("depth > 0").select("id", "depth", F.row_number().over(Window.orderBy("depth", "rank")).alias("rank"))


def find_path(adjacent: DataFrame, start: str, end: str) -> DataFrame:
    """``(step, id)`` of one shortest path over all edges; of equals that whose parents come first by id.

    From a note to itself the path is that note, known or not; without a path the result is empty.
    """
    spark = adjacent.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, id string")
    steps = adjacent.select("src", "dst").distinct()
    known = steps.where(F.col("src").isin(start, end)).select("src").distinct().count()
    frontier = spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int")
    visited, level, found = frontier, 0, False
    while known == 2:
        level += 1
        new = steps.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(new.join(visited.select("id"), "id", "left_anti").select("id", "parent", F.lit(level).alias("depth")), "level")
        if not frontier.limit(1).count():
            break
        visited = cut(visited.unionByName(frontier), "visited")
        if frontier.where(F.col("id") == end).limit(1).count():
            found = True
            break
    if not found:
        return spark.createDataFrame([], "step int, id string")
    path, at = [], end
    for step in range(level, -1, -1):  # one row for each step
        path.append((step, at))
        row = visited.where((F.col("id") == at) & (F.col("depth") == step)).first()
        at = row.parent
    return spark.createDataFrame(sorted(path), "step int, id string")


def contexts(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, title, neighbour, neighbour_title, weight, relation_type, reasons, place)``: neighbours by weight, ties by id; unknown titles are ids.

    An edge of a note to itself makes it its own neighbour once.
    """
    adjacent = _both_ways(edges, False)
    titles = notes.select(F.col("id").alias("dst"), F.col("title").alias("neighbour_title"))
    place = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst"))
    placed = adjacent.withColumn("place", F.row_number().over(place))
    named = notes.select(F.col("id").alias("src"), "title")
    return placed.join(named, "src").join(titles, "dst", "left").select(F.col("src").alias("id"), "title", F.col("dst").alias("neighbour"), F.coalesce("neighbour_title", "dst").alias("neighbour_title"), "weight", "relation_type", F.array_join("reasons", ",").alias("reasons"), "place")


def graph_json(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines ``(kind, json)``: an export of any size, one object per row."""
    nodes = notes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", F.col("title").alias("label"))).alias("json"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "weight", "reasons", F.col("relation_type").alias("relationType"))).alias("json")))
