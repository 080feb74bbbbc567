"""Queries of the training-data problems over the project's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import fuse, leaks, markup, mojibake, neighbours, packing
from lorevine.llm.history_dedup import HistoryDedup
from lorevine.llm.near_dup import group_pairs, near_duplicates
from lorevine.llm.set_join import all_pairs, item_sets, note_items
from lorevine.plans.notes import norm_sql
from lorevine.runtime import cut, scratch, table

#: What the project states for repeated note details: words of a shingle, similarity, fewest words.
DETAIL_WORDS, DETAIL_SIMILARITY, DETAIL_LEAST = 3, 0.6, 20


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches go one after the other through a fresh store; the number of batches is read from the table."""
    details = table(spark, sf_dir, "note_details")
    index = HistoryDedup(spark, scratch(spark, "history"), ["title", "body"], DETAIL_WORDS, DETAIL_SIMILARITY, DETAIL_LEAST)
    for row in details.select("batch_no").where("batch_no IS NOT NULL").distinct().orderBy("batch_no").collect():
        index.add(details.where(F.col("batch_no") == row.batch_no), "rec_id", row.batch_no)
    new = details.where("batch_no >= 1").select(F.col("rec_id").alias("rec"))
    return index.repeats().join(new, "rec", "left_semi").select(F.col("first").alias("first_rec_id"), F.col("rec").alias("rec_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = table(spark, sf_dir, "note_details")
    return all_pairs(item_sets(details, "rec_id", note_items(), 6), 0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.entry_vectors(table(spark, sf_dir, "cache_entries"), 96)
    near = neighbours.nearest(vectors, 5, 0.85)
    return near.select(F.least("key", "near").alias("vec_a"), F.greatest("key", "near").alias("vec_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = table(spark, sf_dir, "note_details")
    members, _ = near_duplicates(details, "rec_id", ["title", "body"], DETAIL_WORDS, DETAIL_SIMILARITY, DETAIL_LEAST)
    return group_pairs(members)


#: Hit lists that rate a note, and all its scores.
LISTS = ["keyword", "semantic", "rerank"]
SCORES = [*LISTS, "importance"]


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.fused(fuse.search_scores(table(spark, sf_dir, "search_results"), table(spark, sf_dir, "notes"), LISTS), "query_id", "id", SCORES)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.leaders(_fused(spark, sf_dir), "query_id", "id", SCORES)


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes of all queries in one ranking."""
    return fuse.ranked(_fused(spark, sf_dir), "query_id", "id").select("query_id", "rank", "id", F.round("fused", 6).alias("fused"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = markup.cleaned(table(spark, sf_dir, "note_details"), "rec_id", "body")
    return clean.where(F.size("kinds") > 0).select(F.col("key").alias("rec_id"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every record."""
    return markup.cleaned(table(spark, sf_dir, "note_details"), "rec_id", "body").select(F.col("key").alias("rec_id"), "clean_text", F.array_join("kinds", ", ").alias("kinds"))


#: Tokens of a container.
CAPACITY = 2048


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(packing.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    return packing.packed(sizes, CAPACITY).withColumnRenamed("key", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leaks.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", 0.5)
    return hits.where("shared >= 0.5").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of an item's words in windows with one word substituted or none, with both shares."""
    hits = leaks.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", 0.3)
    return hits.where("tolerant >= 0.5").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("shared", 6).alias("shared"), F.round("tolerant", 6).alias("tolerant"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their restored text and what was wrong."""
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "restored", F.array_join("wrong", ", ").alias("wrong"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p6_found, p6_ranking, p7_found, p7_clean, p8_packed, p9_found, p9_tolerant, p10_found, p10_restored)}

_LINKS = r"""
w AS (SELECT rec_id, batch_no, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{L}\p{N}]+') AS w FROM note_details),
s AS (SELECT DISTINCT rec_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY rec_id), p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rec_id < y.rec_id GROUP BY x.rec_id, y.rec_id),
l AS (SELECT a, b FROM p JOIN n x ON x.rec_id = a JOIN n y ON y.rec_id = b WHERE c >= 0.6::DOUBLE * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(node, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)"""

_VECTOR = "len(v) = 96 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"



def _poly_sql(x: str, k: list[float]) -> str:
    out = f"{k[0]}::DOUBLE"
    for y in k[1:]:
        out = f"(({out}) * {x} + ({y}::DOUBLE))"
    return out


def _quantile_sql(p: str) -> str:
    """The quantile of the standard normal distribution in SQL."""
    a, b, c, d = fuse.QUANTILE
    low, high, q = f"sqrt(-2.0::DOUBLE * ln({p}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {p}))", f"({p} - 0.5::DOUBLE)"
    middle = f"{_poly_sql(f'({q} * {q})', a)} * {q} / {_poly_sql(f'({q} * {q})', [*b, 1.0])}"
    return f"CASE WHEN {p} < 0.02425 THEN {_poly_sql(low, c)} / {_poly_sql(low, [*d, 1.0])} WHEN {p} > 1 - 0.02425 THEN -{_poly_sql(high, c)} / {_poly_sql(high, [*d, 1.0])} ELSE {middle} END"


_RATED = """
h AS (SELECT query_id, id, list_name, max(score) FILTER (WHERE isfinite(score)) AS score FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL AND list_name IN ('keyword', 'semantic', 'rerank') GROUP BY query_id, id, list_name),
w AS (SELECT h.query_id, h.id, max(score) FILTER (WHERE list_name = 'keyword') AS k, max(score) FILTER (WHERE list_name = 'semantic') AS s, max(score) FILTER (WHERE list_name = 'rerank') AS r,
  CAST(coalesce(max(greatest(0, least(10, coalesce(n.importance, 0)))), 0) AS DOUBLE) AS i FROM h LEFT JOIN notes n ON n.id = h.id GROUP BY h.query_id, h.id)"""
_SHARES = ", ".join(f"((rank() OVER (PARTITION BY query_id ORDER BY {c} NULLS FIRST) - 1) + count(*) OVER (PARTITION BY query_id, {c}) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id) AS p{c}" for c in "ksri")

ORACLES = {
    "p6_ranking": f"""WITH {_RATED}, sh AS (SELECT query_id, id, {_SHARES} FROM w), fu AS (SELECT query_id, id, round(({' + '.join(f'({_quantile_sql(f"p{c}")})' for c in 'ksri')}) / 4.0::DOUBLE, 9) AS fused FROM sh)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank, id, round(fused, 6) AS fused FROM fu""",
    "p1_found": f"WITH RECURSIVE {_LINKS}, f AS (SELECT node, min(other) AS first FROM r GROUP BY node) SELECT f.first AS first_rec_id, f.node AS rec_id FROM f WHERE f.node IN (SELECT b FROM l) AND f.node IN (SELECT rec_id FROM note_details WHERE batch_no >= 1)",
    "p2_found": rf"""
WITH i AS (SELECT rec_id, 't:' || lower(trim(regexp_replace(trim(t), '^#+', ''))) AS x FROM (SELECT rec_id, unnest(tags) AS t FROM note_details) WHERE t IS NOT NULL
  UNION SELECT rec_id, 'l:' || {norm_sql('raw')} FROM (SELECT rec_id, unnest(wiki_links) AS raw FROM note_details) WHERE raw IS NOT NULL),
k AS (SELECT rec_id, x FROM i WHERE x <> 't:'), n AS (SELECT rec_id, count(*) AS n FROM k GROUP BY rec_id HAVING count(*) >= 6),
p AS (SELECT a.rec_id AS a, b.rec_id AS b, count(*) AS c FROM k a JOIN k b ON a.x = b.x AND a.rec_id < b.rec_id GROUP BY a.rec_id, b.rec_id)
SELECT a AS rec_a, b AS rec_b FROM p JOIN n x ON x.rec_id = a JOIN n y ON y.rec_id = b WHERE c >= 0.6::DOUBLE * (x.n + y.n - c) - 1e-9""",
    "p4_found": f"""
WITH raw AS (SELECT entry_id * 100 AS key, id, embedding AS v FROM cache_entries UNION ALL SELECT entry_id * 100 + unnest(range(1, len(chunk_embeddings) + 1)), id, unnest(chunk_embeddings) FROM cache_entries),
g AS (SELECT key, coalesce(id, '') AS id, CAST(v AS DOUBLE[]) AS v FROM raw WHERE {_VECTOR}), u AS (SELECT key, id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g),
c AS (SELECT a.key AS a, b.key AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.85),
t AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t""",
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT node AS rec_a, other AS rec_b FROM r WHERE node < other",
    "p6_found": """
WITH h AS (SELECT query_id, id, list_name, max(score) FILTER (WHERE isfinite(score)) AS score FROM search_results WHERE query_id IS NOT NULL AND id IS NOT NULL AND list_name IN ('keyword', 'semantic', 'rerank') GROUP BY query_id, id, list_name),
w AS (SELECT h.query_id, h.id, coalesce(max(score) FILTER (WHERE list_name = 'keyword'), -1e300) AS k, coalesce(max(score) FILTER (WHERE list_name = 'semantic'), -1e300) AS s, coalesce(max(score) FILTER (WHERE list_name = 'rerank'), -1e300) AS r,
  coalesce(max(greatest(0, least(10, coalesce(n.importance, 0)))), 0) AS i FROM h LEFT JOIN notes n ON n.id = h.id GROUP BY h.query_id, h.id)
SELECT a.query_id, a.id FROM w a LEFT JOIN w b ON a.query_id = b.query_id AND a.id <> b.id
GROUP BY a.query_id, a.id HAVING coalesce(min(sign(a.k - b.k) + sign(a.s - b.s) + sign(a.r - b.r) + sign(a.i - b.i)), 1) > 0""",
    "p9_found": r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
it AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM iw), ig AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM it WINDOW o AS (PARTITION BY item_id ORDER BY i)) WHERE g IS NOT NULL),
dt AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM dw), dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id)
SELECT doc_id, ig.item_id FROM dg JOIN ig ON dg.g = ig.g JOIN n ON n.item_id = ig.item_id GROUP BY doc_id, ig.item_id, n.n HAVING count(*) >= 0.5 * n.n""",
}
