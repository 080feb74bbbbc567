"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from lorevine.functions import markdown as md
from lorevine.functions.ids import normalize_id
from lorevine.operators import compress
from lorevine.operators.models import encode_pair, pretokenize, wordpiece
from lorevine.runtime import cut, discard


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [
    ("Spring Boot", "spring-boot.md"), ("agents/My Note", "agents/my-note.md"), ("skills/java/spring-ai.md", "skills/java/spring-ai.md"), ("../x", "x.md"), ("a_b", "a-b.md"), ("", "untitled.md"),
    (" daily\\Some  Note.MD ", "daily/some-note.md"), ("--", "untitled.md"), (None, None)])
def test_normalize_id(spark, raw, want):
    assert one(spark, normalize_id(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("content", "want"), [
    ("# One\ntext", "One"), ("---\n# no\n---\n# Yes \n", "Yes"), ("---\n# hidden\n", "note"), ("no heading", "note"), (None, "note"), ("\n" * 25 + "# late", "note"), ("a\r\n# B\r\n", "B")])
def test_title(spark, content, want):
    assert one(spark, md.title(F.col("i"), F.col("c")), i="x/note.md", c=content) == want


def test_tags(spark):
    assert one(spark, md.tags(F.col("c")), c="#A text ```\n#code\n``` #fff http://h/#x a#b #a ##d") == ["a", "code", "d", "fff"]


def test_links_and_types(spark):
    content = "[[Spring Boot|depends on]] `[[no]]` [[kafka.md]] [[kafka.md|uses]] [[ ]] ```\n[[code]]\n```"
    assert one(spark, md.links(F.col("c")), c=content) == ["kafka.md", "spring-boot.md"]
    assert one(spark, md.link_types(F.col("c")), c=content) == {"spring-boot.md": "depends_on", "kafka.md": "uses"}


def test_body(spark):
    content = "---\nimportance: 3\n---\n#a #b\n# Title\n#kept\ntext\n"
    assert one(spark, md.body(F.col("c")), c=content) == "#kept\ntext"
    assert one(spark, md.body(F.col("c")), c=None) == ""
    assert one(spark, md.body(F.col("c")), c="---\nnever closed") == "---\nnever closed"


def test_paragraphs(spark):
    assert one(spark, md.paragraphs(F.col("c")), c="x" * 49 + "\n\n" + "y" * 50) == ["y" * 50]


def test_importance(spark):
    assert one(spark, md.frontmatter_int(F.col("c"), "importance"), c="---\nimportance: x\nimportance: 7\n---\n") == 7
    assert one(spark, md.frontmatter_int(F.col("c"), "importance"), c="importance: 7") == 0


def test_section(spark):
    content = "# A\nx\n## B\ny\n### C\nz\n## D\nw"
    assert one(spark, md.section(F.col("c"), "b"), c=content) == "## B\ny\n### C\nz"
    assert one(spark, md.section(F.col("c"), "none"), c=content) is None


def test_frontmatter_field(spark):
    f = md.set_frontmatter(F.col("c"), "importance", F.lit(5))
    assert one(spark, f, c="---\na: 1\nimportance: 2\n---\nx") == "---\na: 1\nimportance: 5\n---\nx"
    assert one(spark, f, c="---\na: 1\n---\nx") == "---\na: 1\nimportance: 5\n---\nx"
    assert one(spark, f, c="x") == "---\nimportance: 5\n---\nx"


def test_compression(spark):
    short, long = "one two three four five six seven eight nine", "extraordinary tiny " * 10
    assert one(spark, compress.compress_threshold(F.col("c")), c=short) == short
    assert one(spark, compress.compress_threshold(F.col("c")), c=long) == " ".join(["extraordinary"] * 10)
    assert one(spark, compress.compress_threshold(F.col("c")), c="a " * 12) == "a " * 12
    assert one(spark, compress.compress_share(F.col("c"), 0.5), c=long) == " ".join(["extraordinary"] * 10)
    assert one(spark, compress.compress_threshold(F.col("c")), c=None) == ""


def test_length_guard(spark):
    words = "an extraordinary " * 18  # 306 characters
    guarded = compress.compress_long(F.col("c"))
    assert one(spark, guarded, c=words[:299]) == words[:299] and one(spark, guarded, c=None) is None
    assert one(spark, guarded, c="x" + words[:299]) == " ".join((("x" + words[:299]).split())[1::2])


def test_model_compression(spark):
    df = spark.createDataFrame([(1, "keep drop " * 10), (2, None), (3, "fail " * 12)], "k int, t string")

    def score(words):
        if "fail" in words:
            raise ValueError
        return [1.0 if w == "keep" else 0.0 for w in words]

    got = {r.key: r.compressed for r in compress.with_model(df, "k", "t", score).collect()}
    assert got == {1: " ".join(["keep"] * 10), 2: None, 3: " ".join(["fail"] * 12)}


def test_wordpiece():
    assert pretokenize("Café, naïve 漢字!") == ["cafe", ",", "naive", "漢", "字", "!"]
    vocabulary = {w: i for i, w in enumerate(["[CLS]", "[SEP]", "[UNK]", "un", "##able", "##a", "x"])}
    assert wordpiece("unable", vocabulary) == ["un", "##able"]
    assert wordpiece("xy", vocabulary) == ["[UNK]"]
    assert wordpiece("x" * 101, vocabulary) == ["[UNK]"]
    ids, kinds = encode_pair("x x x x", "unable x", vocabulary, 9)
    assert ids == [0, 6, 6, 6, 1, 3, 4, 6, 1] and kinds == [0] * 5 + [1] * 4


def test_routed_compression(spark):
    long = " ".join(["extraordinary", "a"] * 40)
    df = spark.createDataFrame([("log", long), ("text", long), ("log", "short"), (None, long), ("text", None), ("keep", long)], "k string, t string")
    got, skipped = compress.routed(F.col("t"), F.col("k"), {"log": lambda c: F.substring(c, 1, 5), "keep": lambda c: c})
    want = [("extra", False), (" ".join(["extraordinary"] * 40), False), ("short", True), (" ".join(["extraordinary"] * 40), False), (None, True), (long, True)]
    assert [tuple(r) for r in df.select(got, skipped).collect()] == want


def test_word_max(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.7), (1, 1, 0.1), (1, None, 0.9)], "doc int, word_id int, score double")
    assert sorted(map(tuple, compress.word_max(df, ["doc"]).collect())) == [(1, 0, 0.7), (1, 1, 0.1)]


def test_discard(spark):
    one = cut(spark.range(3))
    assert one.count() == 3
    discard(one)
    with pytest.raises(Exception):
        one.collect()
