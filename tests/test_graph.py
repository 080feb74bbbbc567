"""Literal cases of the graph and of retrieval."""

import re

import pytest
from pyspark.sql import functions as F

from lorevine.functions.markdown import body
from lorevine.operators import graph, mutate, relate, retrieve
from lorevine.sources.notes import parse, read_files, write_files

CORPUS = {
    "queue.md": "# Queue of tasks\nTasks wait here until a worker takes one; each is given out once.\nCompare [[worker.md]] and [[store.md]].\n#runtime #design\n",
    "worker.md": "# Worker pool\nA pool of processes that drain whatever is pending, in #runtime order.\n",
    "store.md": "# Store\nKeeps what finished, for replay and audit of the #runtime side.\nFilled from [[queue.md]] at night.\n",
}


def notes(spark, corpus):
    return parse(spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(corpus.items())], "ord long, id string, content string"))


def edges(spark, corpus):
    return {(r.source, r.target): (r.weight, r.relation_type) for r in relate.build_edges(notes(spark, corpus)).collect()}


def test_three_notes(spark):
    # one shared tag each; one link, then links in both directions; keywords shared: none, "worker", "queue"
    got = edges(spark, CORPUS)
    assert {k: t for k, (_, t) in got.items()} == {("store.md", "worker.md"): "related_topic", ("queue.md", "worker.md"): "references", ("queue.md", "store.md"): "references"}
    assert got["store.md", "worker.md"][0] >= 2 and got["queue.md", "worker.md"][0] >= 5 + 2 and got["queue.md", "store.md"][0] >= 10 + 2


def test_weights(spark):
    got = edges(spark, {"a.md": "# A\n[[b.md]] #tag1\n", "b.md": "# B\n#tag1\n", "c.md": "# C\n#tag1\n"})
    assert {k: v[0] for k, v in got.items()} == {("a.md", "b.md"): 8, ("a.md", "c.md"): 3, ("b.md", "c.md"): 3}


def test_self_and_typed_links(spark):
    got = edges(spark, {"a.md": "[[a.md]] [[b.md|depends on]] [[gone]]", "b.md": "x"})
    assert got == {("a.md", "a.md"): (5, "references"), ("a.md", "b.md"): (5, "depends_on")}


@pytest.mark.parametrize(("size", "pairs"), [(500, 500 * 499 // 2), (501, 0)])
def test_bucket_guard(spark, size, pairs):
    df = spark.range(size).select(F.concat(F.lit("n"), "id").alias("id"), F.array(F.lit("t")).alias("tags"))
    assert relate.bucket_pairs(df, "tags").count() == pairs


def test_traversal(spark):
    corpus = {"hub.md": "# Hub\n[[left.md]]\n[[right.md]]\n#near\n", "left.md": "# Left\n[[far.md]]\n#near\n", "right.md": "# Right\n#near\n", "far.md": "# Far\n#away\n", "island.md": "# Island\n#alone\n"}
    adjacent = graph.adjacency(relate.build_edges(notes(spark, corpus)))
    walk = lambda *a: [(r.id, r.depth) for r in graph.traverse(adjacent, *a).orderBy("rank").collect()]
    assert walk("hub.md", 1, 5, 1) == [("left.md", 1), ("right.md", 1)]
    assert walk("hub.md", 2, 5, 1) == [("left.md", 1), ("right.md", 1), ("far.md", 2)]
    assert walk("nobody.md", 2, 5, 1) == [] and walk("hub.md", 0, 5, 1) == []


def test_limit_comes_before_visited(spark):
    rows = [("s", "a", 9), ("a", "b", 1)]
    e = spark.createDataFrame([(s, t, w, ["x"], "related") for s, t, w in rows], "source string, target string, weight int, reasons array<string>, relation_type string")
    adjacent = graph.adjacency(e)
    assert [r.id for r in graph.traverse(adjacent, "s", 3, 1, 1).collect()] == ["a"]
    assert [r.id for r in graph.traverse(adjacent, "s", 3, 2, 1).orderBy("rank").collect()] == ["a", "b"]
    path = [r.id for r in graph.find_path(adjacent, "s", "b").orderBy("step").collect()]
    assert path == ["s", "a", "b"]
    assert [r.id for r in graph.find_path(adjacent, "gone", "gone").collect()] == ["gone"]
    assert graph.find_path(adjacent, "s", "gone").count() == 0


def test_path_notes(spark, tmp_path):
    import __spark_entry__ as entry

    # two shortest paths over b and c, whose first steps tie at the end; a longer one over a
    links = {"index.md": ["m.md", "x.md"], "m.md": ["c.md"], "x.md": ["b.md"], "b.md": ["glossary/terms.md"], "c.md": ["glossary/terms.md"], "glossary/terms.md": [], "a.md": ["index.md", "z.md"], "z.md": ["y.md"], "y.md": ["glossary/terms.md"]}
    parse(spark.createDataFrame([(i, k, " ".join(f"[[{x}]]" for x in v)) for i, (k, v) in enumerate(links.items())], "ord long, id string, content string")).write.parquet(f"{tmp_path}/notes.parquet")
    path = entry.queries()["shortest_path_notes"](spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.step, r.id) for r in path] == [(0, "index.md"), (1, "x.md"), (2, "b.md"), (3, "glossary/terms.md")]


def test_keyword_search(spark):
    corpus = {"tea.md": "# Green tea\nSteep green leaves; green tea is best at 80 degrees.\n#drink\n", "pot.md": "# Tea pot\nA pot of clay, to steep in.\n#ware\n", "чай.md": "# Зелёный чай\nЧай заваривают дважды.\n#drink\n", "salt.md": "# Salt\nPreserve with salt and lemon.\n#food\n"}
    n = notes(spark, corpus).cache()
    index = retrieve.build_index(n)
    assert [r.id for r in retrieve.keyword_search(index, "Green steep", 5).collect()] == ["tea.md"]
    ids = lambda q: sorted(r.id for r in retrieve.keyword_scores(index, q).collect())
    assert ids("") == [] and ids("-tea") == []
    assert ids("salt OR pot") == ["pot.md", "salt.md"] and ids("steep AND (pot OR salt)") == ["pot.md"]
    assert ids("(salt OR pot) AND nothing") == [] and ids("tea -(clay OR salt)") == ["tea.md"]
    assert ids("tags:drink -green") == ["чай.md"] and ids("чай") == ["чай.md"] and ids("ЗЕЛЁНЫЙ") == ["чай.md"]
    assert ids('"green tea"') == ["tea.md"] and ids('"tea green"') == [] and ids('"tea green" OR pot') == ["pot.md"] and ids('steep -"green tea"') == ["pot.md"]
    assert ids("prese*") == ["salt.md"] and ids("lemno~2") == ["salt.md"] and ids("[le TO lez] steep") == ["tea.md"] and ids("/le(mon|aves)/") == ["salt.md", "tea.md"]
    assert ids('broken " quote') == [] and ids('tea (steep') == ids("tea steep") and ids("tea OR") == []
    one, two = ({r.id: r.score for r in retrieve.keyword_scores(index, q).collect()} for q in ("pot", "pot^3"))
    assert two["pot.md"] == pytest.approx(3 * one["pot.md"])


def test_stored_index(spark, tmp_path):
    n = notes(spark, CORPUS)
    n.drop("ord").withColumn("ord", F.lit(1)).write.parquet(f"{tmp_path}/notes")
    index = retrieve.build_index(n)
    stored = retrieve.stored_index(spark.read.parquet(f"{tmp_path}/notes"), f"file://{tmp_path}")
    again = retrieve.stored_index(spark.read.parquet(f"{tmp_path}/notes"), f"file://{tmp_path}")
    assert stored.postings.inputFiles() == again.postings.inputFiles()
    want = [tuple(r) for r in retrieve.keyword_search(index, "pool", 5).collect()]
    assert want and [tuple(r) for r in retrieve.keyword_search(stored, "pool", 5).collect()] == want
    new = {**CORPUS, "worker.md": "# Hands\nNothing here but a queue."}
    new.pop("store.md")
    changed = notes(spark, {"worker.md": new["worker.md"]})
    after, fresh = retrieve.upsert_index(stored, changed, n.where("id = 'store.md'").select("id")), retrieve.build_index(notes(spark, new))
    for name in ("postings", "stats", "frequency"):
        one, two = getattr(after, name), getattr(fresh, name)
        assert sorted(map(tuple, one.select(two.columns).collect())) == sorted(map(tuple, two.collect()))


def test_links_from_own_text(spark):
    corpus = {**CORPUS, "stub.md": "# Worker\n", "copy.md": CORPUS["worker.md"], "replay.md": "# Store\n#runtime replay, store replay\n", "none.md": "# !\n", "unheard.md": "# Worker unheard\nzebra " + "x" * 600}
    n = notes(spark, corpus).cache()
    index = retrieve.build_index(n)
    texts = n.select(F.col("id").alias("src"), retrieve.link_query(F.col("title"), body(F.col("content"))).alias("text"))
    for k in (1, 2, 5):
        got = {}
        for r in retrieve.keyword_links(index, texts, k).orderBy("rank").collect():
            got.setdefault(r.src, []).append((r.id, r.score))
        found = {r.src: retrieve.keyword_search(index, " ".join(re.findall("[a-z0-9]+", r.text.lower())), k).orderBy("rank").collect() for r in texts.collect()}
        want = {src: [(h.id, h.score) for h in hits if h.id != src] for src, hits in found.items()}
        assert got == {src: hits for src, hits in want.items() if hits}
    assert [i for i, _ in got["copy.md"]] == ["worker.md"] and len(got["stub.md"]) > 1 and "store.md" in dict(got["replay.md"])
    assert not {"none.md", "unheard.md"} & set(got)


def test_boost(spark):
    now = 1_000_000_000_000
    row = spark.createDataFrame([(0, now), (0, now - 302_400_000), (0, now - 604_800_000), (10, None), (None, None)], "i int, t long")
    assert [round(r.b, 6) for r in row.select(retrieve.metadata_boost(F.col("i"), F.col("t"), now).alias("b")).collect()] == [0.05, 0.025, 0.0, 0.1, 0.0]


def test_hybrid_without_vectors(spark):
    kw = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    got = retrieve.hybrid(kw, kw.limit(0), None, 5).collect()
    assert [(r.id, round(r.score, 3)) for r in got] == [("a", 0.2), ("b", 0.1)]


def test_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "b.md").write_text("# B\n")
    (tmp_path / "sub dir" / "A note.md").write_text("# A ü\n")
    (tmp_path / "skip.txt").write_text("no")
    got = [(r.ord, r.id, r.content) for r in read_files(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(0, "b.md", "# B\n"), (1, "sub dir/A note.md", "# A ü\n")]
    out = tmp_path / "out"
    out.mkdir()
    write_files(spark.createDataFrame([("x/../Y z", "text")], "id string, content string"), str(out))
    assert (out / "x" / "y-z.md").read_text() == "text"


def test_mutations(spark):
    n = spark.createDataFrame([("a.md", "x", 0), ("b.md", "y", 3)], "id string, content string, importance int")
    with pytest.raises(ValueError):
        mutate.create(n, spark.createDataFrame([("A", "z", 0)], n.schema))
    assert mutate.create(n, spark.createDataFrame([("c", "z", 0)], n.schema)).count() == 3
    with pytest.raises(ValueError):
        mutate.update(n, spark.createDataFrame([("c.md", "z", 0)], n.schema))
    assert {r.content for r in mutate.update(n, spark.createDataFrame([("a.md", "z", 0)], n.schema)).collect()} == {"z", "y"}
    with pytest.raises(ValueError):
        mutate.delete(n, "c.md")
    assert [r.id for r in mutate.delete(n, "a.md").collect()] == ["b.md"]
    assert mutate.set_importance(n, "a.md", 99).where("id = 'a.md'").first().content == "---\nimportance: 10\n---\nx"
