"""Links found from the text of every note."""

import random

from pyspark.sql import functions as F

from lorevine.functions.words import words
from lorevine.operators import contain
from lorevine.plans.notes import ORACLES, QUERIES
from tests.compare import connect, differences

SCHEMA = "ord long, id string, title string, content string, wiki_links array<string>, tags array<string>, headings array<string>"


def stored(spark, tmp_path, rows):
    """Notes written as a table; how the query's rows differ from those of its SQL."""
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "notes.parquet")
    return differences(QUERIES["auto_links"](spark, str(tmp_path)), connect(tmp_path), ORACLES["auto_links"])


def shuffled(spark) -> dict[int, int]:
    """Bytes that each stage so far has written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_auto_links_shuffle_few_bytes(spark, tmp_path):
    # 40 of 80 words each: the rarest is in hundreds of notes, and few hold all words of another
    rng, names = random.Random(5), [f"word{i}" for i in range(80)]
    rows = [(f"n{i}.md", "note", "# note\n" + " ".join(rng.sample(names, 40)), None, [], []) for i in range(800)]
    rows += [(f"long{i}.md", "note", f"# note\n{' '.join(names)}", [], [], []) for i in range(6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to send
    try:
        before = set(shuffled(spark))
        extra, missing = stored(spark, tmp_path, rows)
        written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not extra and not missing
    assert written < 5_000_000


def test_auto_links_of_odd_notes(spark, tmp_path):
    texts = ["tea", "tea pot", "Tea, pot; tea!", "чай и Tea", "\U0001d7d8\U0001d7d9 tea", "", None, "!!", "  ", "tea\n\npot " + "x" * 600, "# Tea\npot pot", "---\nimportance: 3\n---\n# Pot\n#tags only\ntea", "1 2 3 tea", "ТЕА\ttea é"]
    rows = [(f"d{i % 3}/n{i}-{j}.md", title, text, links, tags, heads) for i, text in enumerate(texts) for j, (title, links, tags, heads) in enumerate([("Tea", ["d0/n0-0.md"], ["tea"], ["Pot"]), (None, None, None, None), ("", [], [], []), ("pot", ["d1/n1-0.md", "d1/n1-0.md"], ["a", "b"], ["tea pot"])])]
    extra, missing = stored(spark, tmp_path, rows)
    assert not extra and not missing


def test_split_as_words(spark):
    texts = [("",), (None,), (" a",), ("A b,c ",), ("!!",), ("Ünï-cödé 12½ x́y",), ("\U0001d7d8a\U0001f600b",), ("İstanbul ǅ",)]
    for r in spark.createDataFrame(texts, "t string").select(words(F.col("t")).alias("a"), contain.split(F.col("t")).alias("b")).collect():
        assert r.a == r.b


def test_many_queries_meet_one_document(spark):
    # more queries than one row takes; those of the same words share a key
    one = "all of these words " + " ".join(f"w{i}" for i in range(60))
    documents = spark.createDataFrame([("d", [("content", one)]), ("e", [("content", "these words")])], "id string, held array<struct<field: string, value: string>>")
    queries = spark.createDataFrame([(f"q{i}", f"words w{i}") for i in range(60)] + [("r", "w7 WORDS"), ("s", "words absent")], "src string, text string")
    frequency = documents.select(F.explode(contain.split(F.element_at("held", 1)["value"])).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    matches, asked = contain.holders(queries, documents, frequency, 5)
    got = matches.collect()
    assert {(r.key, r.id) for r in got} == {(f"q{i}", "d") for i in range(60)} and len(got) == 120
    assert {r.src: r.key for r in asked.collect()} == {**{f"q{i}": f"q{i}" for i in range(60)}, "r": "q7"}
