"""Keyword, vector and hybrid retrieval over notes and chunks.

The keyword index is three tables (postings with positions, term frequencies, field statistics), built once with map-side counts, stored in order of field and term, and read by a join on the
query's few terms. A query string is parsed to a tree of clauses, whose words and phrases are looked up side by side and joined by boolean columns. Vector search is exact: similarities are computed where the vectors lie and only each task's best ``k`` leave it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorevine.functions.ids import folder_of
from lorevine.functions.markdown import text
from lorevine.functions.words import words
from lorevine.operators import contain
from lorevine.runtime import cut

#: Boosts of the indexed fields.
FIELDS = {"title": 3.0, "headings": 2.0, "tags": 2.0, "folder": 2.0, "content": 1.0}
K1, B = 1.2, 0.75
KEYWORD_SHARE, VECTOR_SHARE = 0.2, 0.8
WEEK_MS = 604_800_000


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any writing."""
    return words(c)


@dataclass
class Index:
    """``postings(field, term, id, tf, dl, positions)``, ``stats(field, docs, avgdl)``, ``frequency(field, term, df)``."""

    postings: DataFrame
    stats: DataFrame
    frequency: DataFrame


def field_values() -> dict[str, Column]:
    """The text of each field, from the columns of a note."""
    joined = {"headings": F.array_join("headings", " "), "tags": F.array_join("tags", " "), "folder": folder_of(F.col("id"))}
    return {f: joined.get(f, F.col(f)) for f in FIELDS}


def field_texts(notes: DataFrame) -> DataFrame:
    """``(id, field, value)`` of the fields that a note has; an empty field is none."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), value.alias("value")) for f, value in field_values().items()])
    return notes.select("id", F.explode(pairs).alias("x")).select("id", F.col("x.field").alias("field"), F.col("x.value").alias("value")).where(F.coalesce(F.trim("value"), F.lit("")) != "")


def build_index(notes: DataFrame) -> Index:
    """The keyword index of ``notes(id, title, content, tags, headings)``."""
    tokens = field_texts(notes).select("id", "field", terms(F.col("value")).alias("t")).where(F.size("t") > 0)
    lengths = tokens.select("id", "field", F.size("t").alias("dl"))
    postings = tokens.select("id", "field", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term")).groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    frequency = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(postings, stats, frequency)


def write_index(index: Index, path: str) -> None:
    """Store an index: postings and frequencies by field and in ranges of terms, so that a query reads the row groups of its terms only."""
    for name, table in (("postings", index.postings), ("frequency", index.frequency)):
        table.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/{name}")
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # one row for each field


def read_index(spark, path: str) -> Index:
    """A stored index."""
    order = {"postings": ["field", "term", "id", "dl", "tf", "positions"], "frequency": ["field", "term", "df"], "stats": ["field", "docs", "avgdl"]}
    return Index(**{name: spark.read.parquet(f"{path}/{name}").select(*columns) for name, columns in order.items()})


def stored_index(notes: DataFrame, root: str) -> Index:
    """The stored index of a table of notes read from files: built and written below ``root`` when the files are new or have changed, else read."""
    spark = notes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in sorted(notes.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(conf).getFileStatus(path)
        state.append(f"{name} {found.getLen()} {found.getModificationTime()}")
    folder = f"{root}/index-{hashlib.sha256(chr(10).join(state).encode()).hexdigest()[:24]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/stats/_SUCCESS")  # statistics are written last
    if not done.getFileSystem(conf).exists(done):
        write_index(build_index(notes), folder)
    return read_index(spark, folder)


def upsert_index(old: Index, changed: DataFrame, removed: DataFrame) -> Index:
    """The index after notes were changed or removed: the old postings of those ids give way to the new, and frequencies and field statistics follow."""
    gone = changed.select("id").unionByName(removed.select("id")).distinct()
    postings = old.postings.join(gone, "id", "left_anti").unionByName(build_index(changed).postings.select(old.postings.columns))
    stats = postings.select("field", "id", "dl").distinct().groupBy("field").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    return Index(postings, stats, postings.groupBy("field", "term").agg(F.count("*").alias("df")))


def bm25(tf: Column, dl: Column, df: Column, docs: Column, avgdl: Column) -> Column:
    idf = F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class Leaf:
    """What a word of a query asks of a term: equality, a prefix, an edit distance, a range or a pattern; or a phrase of several words."""

    words: list[str]
    field: str | None = None
    boost: float = 1.0
    kind: str = "term"
    fuzzy: int = 0
    upper: str = ""

    def matches(self) -> Column:
        t = F.col("term")
        hit = {"prefix": lambda: F.startswith(t, F.lit(self.words[0])), "fuzzy": lambda: F.levenshtein(t, F.lit(self.words[0])) <= self.fuzzy, "range": lambda: t.between(self.words[0], self.upper) if self.upper else t >= self.words[0],
               "pattern": lambda: t.rlike(f"^(?:{self.words[0]})$")}.get(self.kind, lambda: t.isin(*self.words))()
        return hit & (F.col("field") == self.field) if self.field else hit


@dataclass
class Group:
    """Clauses ``(occur, node)`` with ``occur`` one of ``must``, ``should``, ``must_not``."""

    clauses: list[tuple[str, Leaf | Group]] = field(default_factory=list)

    def leaves(self) -> list[Leaf]:
        return [x for _, node in self.clauses for x in (node.leaves() if isinstance(node, Group) else [node])]


_TOKEN = re.compile(r'\s*(?:([-+!]|NOT\b)|(AND\b|&&|OR\b|\|\|)|(?:(\w+):)?(?:"([^"]*)"|/((?:[^/\\]|\\.)+)/|\[([^\s\]]+) TO ([^\s\]]+)\]|(\()|([^\s()"\[\]{}^~*?:!]+[^\s()"\[\]{}:]*|\*))|(\)))(~\d*)?(\^\d+(?:\.\d+)?)?')
_TERM = re.compile(r"[^\W_]+")


def parse_query(query: str) -> Group:
    """Bare words are required; ``a OR b`` makes both optional; ``-x``, ``!x`` and ``NOT x`` exclude; ``+x`` and ``AND`` require; brackets group; ``field:x``, ``x*``, ``x~n``, ``x^b``, ``"a b"``, ``[a TO b]``, ``/pattern/``.

    A query that is no valid syntax (unbalanced quotes or brackets, or a sign without its word) is read as plain words.
    """
    try:
        node, at = _clauses(query, 0, None, 0)
        if at < len(query.rstrip()):
            raise ValueError(query)
        return node
    except ValueError:
        return Group([("must", Leaf([w])) for w in _TERM.findall(query.lower())])


def _clauses(query: str, at: int, name: str | None, depth: int) -> tuple[Group, int]:
    out, sign, joined = Group(), "", ""
    while True:
        if not query[at:].strip():
            if depth:
                raise ValueError(query)
            at = len(query)
            break
        m = _TOKEN.match(query, at)
        if not m or m.end() == at:
            raise ValueError(query)
        at = m.end()
        mark, joint, own, phrase, pattern, low, high, opening, word, closing, near, boost = m.groups()
        if closing:
            if not depth:
                raise ValueError(query)
            break
        if mark:
            sign = mark
            continue
        if joint:
            if not out.clauses or joined:
                raise ValueError(query)
            joined = "OR" if joint in ("OR", "||") else "AND"
            continue
        named = own if own in FIELDS else name
        if own and own not in FIELDS and word is not None:
            word = f"{own} {word}"
        factor = float(boost[1:]) if boost else 1.0
        if opening:
            node, at = _clauses(query, at, named, depth + 1)
            if after := re.match(r"\^(\d+(?:\.\d+)?)", query[at:]):
                at += after.end()
                for leaf in node.leaves():
                    leaf.boost *= float(after[1])
        elif pattern is not None:
            node = Leaf([pattern], named, factor, "pattern")
        elif low is not None:
            node = Leaf(["" if low == "*" else low.lower()], named, factor, "range", upper="" if high == "*" else high.lower())
        elif phrase is not None:
            found = _TERM.findall(phrase.lower())
            node = Leaf(found, named, factor, "phrase" if len(found) > 1 else "term") if found else None
        else:
            kind, fuzzy = "term", 0
            if t := re.search(r"\^(\d+(?:\.\d+)?)$", word):
                factor, word = float(t[1]), word[:t.start()]
            if t := re.search(r"~(\d?)$", word):
                kind, fuzzy, word = "fuzzy", int(t[1] or 2), word[:t.start()]
            elif near:
                kind, fuzzy = "fuzzy", int(near[1:] or 2)
            elif word.endswith("*"):
                kind, word = "prefix", word[:-1]
            found = _TERM.findall(word.lower())
            one = [Leaf([w], named, factor, kind if i == len(found) - 1 else "term", fuzzy) for i, w in enumerate(found)]
            node = None if not one else one[0] if len(one) == 1 else Group([("must", x) for x in one])
        occur = "must_not" if sign in ("-", "!", "NOT") else "should" if joined == "OR" and sign != "+" else "must"
        if joined == "OR" and out.clauses[-1][0] == "must":
            out.clauses[-1] = ("should", out.clauses[-1][1])
        if joined == "AND" and out.clauses[-1][0] == "should":
            out.clauses[-1] = ("must", out.clauses[-1][1])
        if node is not None and (isinstance(node, Leaf) or node.clauses):
            out.clauses.append((occur, node))
        sign, joined = "", ""
    if sign or joined:
        raise ValueError(query)
    return out, at


def _term_hits(index: Index, leaf: Leaf, number: int) -> DataFrame:
    """``(id, leaf, score)`` of one leaf."""
    boosts = F.create_map(*[x for f, b in FIELDS.items() for x in (F.lit(f), F.lit(b))])
    hits = index.postings.where(leaf.matches()).join(index.frequency.where(leaf.matches()), ["field", "term"]).join(F.broadcast(index.stats), "field")  # a row for each field
    if leaf.kind == "phrase":
        # the words of a phrase in one field: places of the first word that the others follow in order
        met = hits.groupBy("field", "id", "dl", "docs", "avgdl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs"))
        places = lambda w: F.coalesce(F.element_at("at", F.lit(w)), F.array().cast("array<int>"))
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(places(w), p + i) for i, w in enumerate(leaf.words)])
        tf = F.size(F.filter(places(leaf.words[0]), follows))
        met = met.withColumn("tf", tf).where("tf > 0")
        part = reduce(lambda a, b: a + b, [bm25(F.col("tf"), F.col("dl"), F.element_at("dfs", F.lit(w)), F.col("docs"), F.col("avgdl")) for w in leaf.words])
    else:
        met, part = hits, bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("docs"), F.col("avgdl"))
    return met.select("id", F.lit(number).alias("leaf"), (part * boosts[F.col("field")] * F.lit(leaf.boost)).alias("score"))


def keyword_scores(index: Index, query: str) -> DataFrame:
    """``(id, score)`` of all notes that match; the fields' BM25 scores times their boosts, summed over the words and phrases that count. A blank query, and one of exclusions alone, matches nothing."""
    tree = parse_query(query)
    leaves = tree.leaves()
    if not any(occur != "must_not" for occur, _ in tree.clauses):
        return index.postings.sparkSession.createDataFrame([], "id string, score double")
    hits = reduce(DataFrame.unionByName, [_term_hits(index, leaf, i) for i, leaf in enumerate(leaves)])
    each = hits.groupBy("id").agg(*[F.sum(F.when(F.col("leaf") == i, F.col("score"))).alias(f"s{i}") for i in range(len(leaves))])
    number = iter(range(len(leaves)))

    def judged(node: Leaf | Group) -> tuple[Column, Column]:
        """Whether a note matches a node, and its score there."""
        if isinstance(node, Leaf):
            score = F.col(f"s{next(number)}")
            return score.isNotNull(), F.coalesce(score, F.lit(0.0))
        parts = [(occur, *judged(child)) for occur, child in node.clauses]
        both = lambda a, b: a & b
        match = reduce(both, [~m if occur == "must_not" else m for occur, m, _ in parts if occur != "should"], F.lit(True))
        if not any(occur == "must" for occur, _, _ in parts):
            wanted = [m for occur, m, _ in parts if occur == "should"]
            match = match & (reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False))
        score = reduce(lambda a, b: a + b, [s for occur, _, s in parts if occur != "must_not"], F.lit(0.0))
        return match, F.when(match, score).otherwise(F.lit(0.0))

    match, score = judged(tree)
    return each.where(match).select("id", F.round(score, 9).alias("score"))  # rounded, so that the order of summing makes no ties


def top(scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The ``k`` best by score, ties by key, with ``rank``."""
    best = scores.orderBy(F.col("score").desc(), *([key] if isinstance(key, str) else key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), *([key] if isinstance(key, str) else key))))


def keyword_search(index: Index, query: str, k: int) -> DataFrame:
    """``(rank, id, score)``."""
    return top(keyword_scores(index, query), k).select("rank", "id", "score")


def link_query(title: Column, body: Column) -> Column:
    """What a note asks for to find links: its title and the first 500 characters of its body."""
    return F.trim(F.concat(text(title), F.lit(" "), F.substring(text(body), 1, 500)))


def keyword_links(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``(src, id, score, rank)``: for each of ``queries(src, text)`` the other notes among the ``k`` that ``keyword_search`` gives for the words of ``text``, in one pass.

    All words must match (a repeated one counts again); texts without words find nothing.
    The note ``src`` takes one of the ``k`` places, so it is scored only where ``k`` other candidates want them; ``rank`` gives the order.
    Query syntax is not looked for: everything in a text is words.
    """
    fields = index.postings.groupBy("id", "field").agg(F.array_join(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))), " ").alias("value"))
    return _links(fields.groupBy("id").agg(F.collect_list(F.struct("field", "value")).alias("held")), index.frequency, index.stats, queries, k)


def note_links(notes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``keyword_links`` over the index of ``notes``, of which only frequencies are made: no posting is written or shuffled."""
    documents = notes.select("id", F.filter(F.array(*[F.struct(F.lit(f).alias("field"), value.alias("value")) for f, value in field_values().items()]), lambda x: F.trim(x["value"]) != "").alias("held"))
    texts = documents.select(F.explode("held").alias("x")).select("x.field", contain.split(F.col("x.value")).alias("t"))
    # a null stands for the field itself, so that one pass counts both; it gives the number of texts that have words
    each = texts.select("field", F.size("t").alias("dl"), F.explode(F.when(F.size("t") > 0, F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string"))))).alias("term"))
    counted = cut(each.groupBy("field", "term").agg(F.count("*").alias("df"), F.avg("dl").alias("avgdl")), "frequency")
    stats = counted.where("term IS NULL").select("field", F.col("df").alias("docs"), "avgdl")
    return _links(documents, counted.where("term IS NOT NULL").select("field", "term", "df"), stats, queries, k)


def _links(documents: DataFrame, frequency: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    matches, asked = contain.holders(queries, documents, frequency, k)
    boosts = F.create_map(*[x for f, b in FIELDS.items() for x in (F.lit(f), F.lit(b))])
    score = bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("docs"), F.col("avgdl")) * boosts[F.col("field")] * F.col("times")
    scored = matches.join(frequency, ["field", "term"]).join(F.broadcast(stats), "field").groupBy("key", "id").agg(F.round(F.sum(score), 9).alias("score"))  # five fields
    place = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return asked.join(best, "key").where(F.col("id") != F.col("src")).select("src", "id", "score", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """``v`` at unit length; a vector of norm up to 1e-9 as it is."""
    n = norm(v)
    return F.when(n > 1e-9, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similarity(v: Column, q: Column) -> Column:
    """``(1 + cosine) / 2``."""
    return (F.lit(1.0) + dot(v, q) / (norm(v) * norm(q))) / 2


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite numbers that are not all zero."""
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``vectors(..., v)`` with ``score``; vectors that are not usable are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(usable(F.col("v"), len(query))).withColumn("score", F.round(similarity(F.col("v"), q), 9)).drop("v")


def mean_pool(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, pos, value)``: the mean of a key's vectors by position."""
    return tokens.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def access_stats(log: DataFrame) -> DataFrame:
    """``(id, accesses, last_ms)`` of an access log; null ids are left out."""
    return log.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("accesses"), F.unix_millis(F.max("ts").cast("timestamp_ltz")).alias("last_ms"))


def metadata_boost(importance: Column, last_ms: Column, now_ms: int) -> Column:
    """A hundredth of the importance, and up to 0.05 for an access within the last week."""
    recent = F.greatest(F.lit(0.0), F.lit(0.05) * (F.lit(1.0) - (F.lit(now_ms) - last_ms) / F.lit(float(WEEK_MS))))
    return F.coalesce(importance, F.lit(0)) * 0.01 + F.when(last_ms > 0, recent).otherwise(F.lit(0.0))


def clamped(importance: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(importance, F.lit(0))))


def hybrid(keyword: DataFrame, vector: DataFrame, boosts: DataFrame | None, k: int, fetch: int | None = None) -> DataFrame:
    """``(rank, id, score)`` of two result lists ``(id, score)``: each scaled by its best, weighted, plus ``boosts(id, boost)`` for what was retrieved.

    ``fetch`` results are fused (default ``k``), twice as many are taken of each list.
    """
    fetch = fetch or k

    def scaled(scores: DataFrame, share: float) -> DataFrame:
        best = scores.orderBy(F.col("score").desc(), "id").limit(2 * fetch)
        most = F.max("score").over(Window.partitionBy())  # over at most 2 * fetch rows
        return best.select("id", (F.col("score") / F.when(most != 0, most).otherwise(F.lit(1.0)) * share).alias("part"))

    fused = scaled(keyword, KEYWORD_SHARE).unionByName(scaled(vector, VECTOR_SHARE)).groupBy("id").agg(F.sum("part").alias("score"))
    if boosts is not None:
        fused = fused.join(boosts, "id", "left").select("id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    return top(fused.withColumn("score", F.round("score", 9)), k).select("rank", "id", "score")


def overlap_score(query: str, passage: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct terms that the passage holds."""
    wanted = sorted(set(_TERM.findall(query.lower())))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array_distinct(terms(passage)), F.array(*[F.lit(w) for w in wanted]))) / F.lit(float(len(wanted)))


def rerank(hits: DataFrame, passages: DataFrame, query: str, k: int, scorer=overlap_score) -> DataFrame:
    """``hits(id, ...)`` reordered by ``scorer(query, passage)`` over ``passages(id, title, content)``; ``scorer`` returns a Column."""
    passage = F.concat_ws(" ", F.col("title"), F.substring(text(F.col("content")), 1, 512))
    return top(hits.select("id").join(passages, "id").select("id", scorer(query, passage).alias("score")), k).select("rank", "id", "score")


def group_chunks(hits: DataFrame) -> DataFrame:
    """Chunk hits ``(id, chunk_index, score)`` by note: first rank, best score, chunks in order of rank, each once."""
    ranked = hits.groupBy("id", "chunk_index").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.orderBy(F.col("score").desc(), "id", "chunk_index")))  # hits are a top-k list
    return ranked.groupBy("id").agg(F.min("r").alias("first_rank"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("r", "chunk_index"))).alias("c")).select("id", "first_rank", "score", F.transform("c", lambda x: x["chunk_index"]).alias("chunks"))
