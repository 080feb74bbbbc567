"""Queries over the note tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorevine.functions import markdown as md
from lorevine.functions.ids import folder_of, normalize_id, slugify
from lorevine.operators import compress, graph, models, mutate, relate, retrieve
from lorevine.operators.increments import latest_changes
from lorevine.runtime import cut, shared_dir, table
from lorevine.sources.notes import chunks, keywords

#: Parameters of the queries.
START, END, QUERY, QUESTION, NOW_MS, SECTION = "index.md", "glossary/terms.md", "gateway budget", "which budget did the gateway reach", 1_772_000_000_000, "Related"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes")


TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"
LINES = r"string_split_regex(coalesce(content, ''), '\r\n|\r|\n')"
NOCODE = r"regexp_replace(regexp_replace(coalesce(content, ''), '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')"


def norm_sql(x: str) -> str:
    """The id rule in SQL."""
    seg = rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(p, {TRIM})), '[^a-z0-9.\-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
    joined = rf"array_to_string(list_filter(list_transform(list_filter(string_split_regex({x}, '[/\\]+'), lambda p: regexp_replace(p, {TRIM}) NOT IN ('', '.', '..')), lambda p: {seg}), lambda p: p <> ''), '/')"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {joined} = '' THEN 'untitled.md' WHEN ends_with({joined}, '.md') THEN {joined} ELSE {joined} || '.md' END"


# ---------------------------------------------------------------- text

@query(rf"""
WITH l AS (SELECT id, list_slice({LINES}, 1, 25) AS h FROM notes), p AS (SELECT id, h, coalesce(list_position(h, '---'), 0) AS o FROM l),
q AS (SELECT id, h, o, coalesce(list_position(list_slice(h, o + 1, 25), '---'), 0) AS c FROM p),
x AS (SELECT id, o, c, unnest(h) AS line, generate_subscripts(h, 1) AS i FROM q),
t AS (SELECT id, arg_min(line, i) AS line FROM x WHERE starts_with(line, '# ') AND (o = 0 OR i < o OR (c > 0 AND i > o + c)) GROUP BY id)
SELECT n.id, coalesce(regexp_replace(substr(t.line, 3), {TRIM}), regexp_replace(regexp_replace(n.id, '^.*/', ''), '\.md$', '')) AS title FROM notes n LEFT JOIN t ON n.id = t.id""")
def note_title(spark, d):
    return _notes(spark, d).select("id", md.title(F.col("id"), F.col("content")).alias("title"))


@query(r"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?:^|[^\w/])#([a-zA-Z][a-zA-Z0-9_-]*)', 1), lambda x: lower(x)))), ' ') AS tags FROM notes""")
def note_tags(spark, d):
    return _notes(spark, d).select("id", F.array_join(md.tags(F.col("content")), " ").alias("tags"))


REFS_SQL = rf"""
c AS (SELECT ord, id, {NOCODE} AS content FROM notes),
m AS (SELECT id, unnest(regexp_extract_all(content, '\[\[([^\]\|\n]+)(?:\|([^\]\n]*))?\]\]', 1)) AS page, unnest(regexp_extract_all(content, '\[\[([^\]\|\n]+)(?:\|([^\]\n]*))?\]\]', 2)) AS kind,
  unnest(range(len(regexp_extract_all(content, '\[\[([^\]\|\n]+)(?:\|([^\]\n]*))?\]\]', 1)))) AS i FROM c),
r AS (SELECT id, i, regexp_replace(page, {TRIM}) AS page, regexp_replace(coalesce(kind, ''), {TRIM}) AS kind FROM m),
refs AS (SELECT id, i, {norm_sql('page')} AS target, CASE WHEN kind <> '' AND kind <> page THEN regexp_replace(lower(kind), '[^a-z0-9_]', '_', 'g') END AS type FROM r WHERE page <> '')"""


@query(f"WITH {REFS_SQL} SELECT DISTINCT id, target FROM refs")
def note_links(spark, d):
    return _notes(spark, d).select("id", F.explode(md.links(F.col("content"))).alias("target"))


@query(f"WITH {REFS_SQL} SELECT id, target, arg_max(type, i) AS type FROM refs WHERE type IS NOT NULL GROUP BY id, target")
def link_types(spark, d):
    return _notes(spark, d).select("id", F.explode(md.link_types(F.col("content"))).alias("target", "type"))


@query(f"SELECT rec_id, raw, {norm_sql('raw')} AS note_id FROM (SELECT rec_id, unnest(wiki_links) AS raw FROM note_details)")
def normalize_note_id(spark, d):
    links = table(spark, d, "note_details").select("rec_id", F.explode("wiki_links").alias("raw"))
    return links.select("rec_id", "raw", normalize_id(F.col("raw")).alias("note_id"))


@query(rf"""
WITH b AS (SELECT id, regexp_replace(regexp_replace(coalesce(content, ''), '(?s)\A---\r?\n.*?\n---\r?(\n|\z)', '\1'), '(?s)```.*?```', ' ', 'g') AS t FROM notes)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '(?m)^ {{0,3}}#{{1,6}}[ \t]+([^\r\n]*?)[ \t]*#*[ \t]*\r?$', 1), lambda x: regexp_replace(x, {TRIM})), lambda x: x <> ''))), '|') AS headings FROM b""")
def note_headings(spark, d):
    return _notes(spark, d).select("id", F.array_join(md.headings(F.col("content")), "|").alias("headings"))


@query(rf"""
WITH p AS (SELECT id, lower(regexp_replace(regexp_replace(regexp_replace({NOCODE}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[\[([^\]|]*)(?:\|[^\]]*)?\]\]', '\1', 'g'), '[#*_~>|\[\](){{}}]', ' ', 'g')) AS t FROM notes),
w AS (SELECT id, unnest(regexp_extract_all(t, '[a-zA-Z]{{3,}}')) AS word FROM p),
k AS (SELECT id, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in md.KEYWORD_STOP_WORDS)}) GROUP BY id, word)
SELECT id, word, CAST(n AS BIGINT) AS n, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS r FROM k) WHERE r <= 15""")
def note_keywords(spark, d):
    counted = _notes(spark, d).select("id", F.explode(md.plain_words(F.col("content"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "word"))
    return counted.withColumn("place", place).where(F.col("place") <= md.MAX_KEYWORDS)


@query(rf"""
WITH l AS (SELECT id, list_slice({LINES}, 1, 30) AS h FROM notes), p AS (SELECT id, h, coalesce(list_position(h, '---'), 0) AS o FROM l),
q AS (SELECT id, h, o, coalesce(list_position(list_slice(h, o + 1, 30), '---'), 0) AS c FROM p), x AS (SELECT id, o, c, unnest(h) AS line, generate_subscripts(h, 1) AS i FROM q),
v AS (SELECT id, i, regexp_replace(substr(line, 12), {TRIM}) AS v FROM x WHERE o > 0 AND i > o AND (c = 0 OR i < o + c) AND starts_with(line, 'importance:')),
f AS (SELECT id, CAST(arg_min(v, i) AS INTEGER) AS v FROM v WHERE regexp_matches(v, '^[+-]?[0-9]{{1,9}}$') GROUP BY id)
SELECT n.id, CAST(greatest(0, least(10, coalesce(f.v, 0))) AS INTEGER) AS importance FROM notes n LEFT JOIN f ON n.id = f.id""")
def note_importance(spark, d):
    return _notes(spark, d).select("id", retrieve.clamped(md.frontmatter_int(F.col("content"), "importance")).cast("int").alias("importance"))


BODY_SQL = rf"""
l AS (SELECT id, {LINES} AS h FROM notes), x AS (SELECT id, h[1] AS first, unnest(h) AS line, generate_subscripts(h, 1) AS i FROM l),
s AS (SELECT id, coalesce(min(i) FILTER (WHERE first = '---' AND i > 1 AND line IN ('---', '...')), 0) AS s FROM x GROUP BY id),
k AS (SELECT x.id, line, i FROM x JOIN s ON x.id = s.id WHERE i > s), h AS (SELECT id, min(i) FILTER (WHERE starts_with(line, '# ')) AS h1 FROM k GROUP BY id),
bodies AS (SELECT k.id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '\A\s+|\s+\z', '', 'g') AS body FROM k JOIN h ON k.id = h.id
  WHERE h1 IS NULL AND NOT regexp_full_match(line, '(#[a-zA-Z][a-zA-Z0-9_-]*\s*)+') OR i > h1 OR (i < h1 AND NOT regexp_full_match(line, '(#[a-zA-Z][a-zA-Z0-9_-]*\s*)+')) GROUP BY k.id)"""


@query(f"WITH {BODY_SQL} SELECT n.id, coalesce(b.body, '') AS body FROM notes n LEFT JOIN bodies b ON n.id = b.id")
def note_body(spark, d):
    return _notes(spark, d).select("id", md.body(F.col("content")).alias("body"))


CHUNKS_SQL = rf"""
raw AS (SELECT id, list_filter(list_transform(string_split_regex(coalesce(content, ''), '\n\s*\n'), lambda x: regexp_replace(x, {TRIM})), lambda x: length(x) >= 50) AS c FROM notes),
chunks AS (SELECT id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_index, unnest(c) AS text FROM raw)"""


@query(f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def note_chunks(spark, d):
    return chunks(_notes(spark, d))


FOLDER_SQL = r"CASE WHEN instr(id, '/') > 1 THEN translate(regexp_replace(id, '/[^/]*$', ''), '/-', '  ') END"


@query(f"SELECT id, {FOLDER_SQL} AS folder FROM notes")
def note_folder(spark, d):
    return _notes(spark, d).select("id", folder_of(F.col("id")).alias("folder"))


@query(rf"""
WITH l AS (SELECT id, {LINES} AS h FROM notes), x AS (SELECT id, unnest(h) AS line, generate_subscripts(h, 1) AS i FROM l),
y AS (SELECT *, length(regexp_extract(regexp_replace(line, {TRIM}), '^(#*)', 1)) AS level, lower(regexp_replace(regexp_replace(regexp_replace(line, {TRIM}), '^#+', ''), {TRIM})) AS name FROM x),
s AS (SELECT id, min(i) AS i, arg_min(level, i) AS level FROM y WHERE level > 0 AND name = 'related' GROUP BY id),
e AS (SELECT s.id, s.i, coalesce(min(y.i), 1000000000) AS e FROM s LEFT JOIN y ON y.id = s.id AND y.i > s.i AND y.level > 0 AND y.level <= s.level GROUP BY s.id, s.i)
SELECT y.id, regexp_replace(string_agg(y.line, chr(10) ORDER BY y.i), {TRIM}) AS section FROM y JOIN e ON y.id = e.id AND y.i >= e.i AND y.i < e.e GROUP BY y.id""")
def read_section(spark, d):
    return _notes(spark, d).select("id", md.section(F.col("content"), SECTION).alias("section")).where("section IS NOT NULL")


@query(rf"SELECT id, substr(regexp_replace(coalesce(title, ''), {TRIM}) || ' ' || substr(coalesce(content, ''), 1, 512), 1, 2048) AS text FROM notes")
def embed_text(spark, d):
    return _notes(spark, d).select("id", md.embed_text(F.col("title"), F.col("content")).alias("text"))


@query("SELECT id, title || ' ' || substr(content, 1, 512) AS rerank_text, substr(content, 1, 600) AS excerpt FROM notes")
def note_excerpts(spark, d):
    return _notes(spark, d).select("id", F.concat_ws(" ", "title", F.substring("content", 1, 512)).alias("rerank_text"), F.substring("content", 1, 600).alias("excerpt"))


@query(r"SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM notes")
def note_slug(spark, d):
    return _notes(spark, d).select("id", slugify(F.col("title")).alias("slug"))


SUMMARY_SQL = rf"""
l AS (SELECT rec_id, string_split_regex(coalesce(body, ''), '\r\n|\r|\n') AS h FROM note_details), x AS (SELECT rec_id, regexp_replace(unnest(h), {TRIM}) AS line, generate_subscripts(h, 1) AS i FROM l),
s AS (SELECT rec_id, arg_min(line, i) AS line FROM x WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '```') GROUP BY rec_id)"""


@query(f"WITH {SUMMARY_SQL} SELECT n.rec_id, coalesce(s.line, '') AS line FROM note_details n LEFT JOIN s ON n.rec_id = s.rec_id")
def summary_line(spark, d):
    return table(spark, d, "note_details").select("rec_id", md.summary_line(F.col("body")).alias("line"))


# Folder, importance and tags of the typed notes.
TYPES = {"skill": ("skills", 8, "skill,reusable"), "instruction": ("instructions", 9, "instruction,agent-rule"), "context": ("context", 6, "context,reference"), "memory": ("memory", 5, "memory,log")}
_TYPE_ROWS = ", ".join(f"('{k}', '{f}', {i}, '{t}')" for k, (f, i, t) in TYPES.items())


@query(f"""WITH {SUMMARY_SQL}, types(kind, folder, importance, base_tags) AS (VALUES {_TYPE_ROWS})
SELECT n.rec_id, t.kind, t.importance, t.base_tags, '> **[' || upper(t.kind) || ']**' || CASE WHEN coalesce(s.line, '') <> '' THEN ' ' || s.line ELSE '' END || chr(10) || chr(10) || coalesce(n.body, '') AS body
FROM note_details n JOIN types t ON t.folder = regexp_extract(n.id, '^([^/]*)/', 1) LEFT JOIN s ON n.rec_id = s.rec_id""")
def typed_search_body(spark, d):
    types = spark.createDataFrame([(k, *v) for k, v in TYPES.items()], "kind string, folder string, importance int, base_tags string")  # four rows
    details = table(spark, d, "note_details").withColumn("folder", F.regexp_extract("id", "^([^/]*)/", 1))
    return details.join(F.broadcast(types), "folder").select("rec_id", "kind", "importance", "base_tags", md.search_body(F.col("kind"), F.col("body")).alias("body"))


@query(r"SELECT id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS terms FROM (SELECT id, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS t FROM notes)")
def tokenize_terms(spark, d):
    return _notes(spark, d).select("id", retrieve.terms(F.col("title")).alias("t")).select("id", F.size("t").alias("n"), F.array_join("t", " ").alias("terms"))


STRIP_SQL = rf"regexp_replace(regexp_replace(regexp_replace(content, '(?i)\b(?:{'|'.join(md.FILTER_STOP_WORDS)})\b', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), {TRIM})"


@query(f"SELECT id, {STRIP_SQL} AS text FROM notes")
def stopword_strip(spark, d):
    return _notes(spark, d).select("id", md.strip_stop_words(F.col("content")).alias("text"))


@query(rf"""SELECT id, CAST(length(content) AS INTEGER) AS chars_before, CAST(length(s) AS INTEGER) AS chars_after, CAST(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS INTEGER) AS words_before,
CAST(len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS INTEGER) AS words_after FROM (SELECT id, content, {STRIP_SQL} AS s FROM notes)""")
def stopword_stats(spark, d):
    stripped = _notes(spark, d).select("id", "content", md.strip_stop_words(F.col("content")).alias("s"))
    return stripped.select("id", F.length("content").alias("chars_before"), F.length("s").alias("chars_after"), F.size(compress.split_words(F.col("content"))).alias("words_before"), F.size(compress.split_words(F.col("s"))).alias("words_after"))


@query(r"""
WITH c AS (SELECT id, content, CASE WHEN instr(substr(content, 4), chr(10) || '---') > 0 THEN instr(substr(content, 4), chr(10) || '---') + 3 ELSE 0 END AS e FROM notes)
SELECT id, CASE WHEN (starts_with(content, '---' || chr(10)) OR starts_with(content, '---' || chr(13) || chr(10))) AND e > 0 THEN
  CASE WHEN contains(substr(content, 1, e - 1), chr(10) || 'importance:') THEN regexp_replace(substr(content, 1, e - 1), '(?m)^importance:.*$', 'importance: 7', 'g') ELSE substr(content, 1, e - 1) || chr(10) || 'importance: 7' END || substr(content, e)
  ELSE '---' || chr(10) || 'importance: 7' || chr(10) || '---' || chr(10) || content END AS content FROM c""")
def set_frontmatter(spark, d):
    return _notes(spark, d).select("id", md.set_frontmatter(F.col("content"), "importance", F.lit(7)).alias("content"))


@query(rf"""
SELECT rec_id, '---' || chr(10) || 'source: batch-' || batch_no || chr(10) || '---' || chr(10) || '# ' || coalesce(regexp_replace(title, {TRIM}), 'Untitled')
 || CASE WHEN len(tags) > 0 THEN chr(10) || array_to_string(list_transform(list_filter(tags, lambda t: t IS NOT NULL), lambda t: '#' || regexp_replace(lower(regexp_replace(t, {TRIM})), '[^a-z0-9_-]', '-', 'g')), ' ') ELSE '' END
 || CASE WHEN regexp_replace(coalesce(body, ''), {TRIM}) <> '' THEN chr(10) || chr(10) || regexp_replace(body, {TRIM}) ELSE '' END
 || CASE WHEN len(wiki_links) > 0 THEN chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || array_to_string(list_transform(list_filter(wiki_links, lambda x: x IS NOT NULL), lambda x: '- [[' || regexp_replace(x, '\.md$', '') || ']]'), chr(10)) ELSE '' END || chr(10) AS note
FROM note_details""")
def render_note(spark, d):
    source = F.concat(F.lit("batch-"), F.col("batch_no").cast("string"))
    return table(spark, d, "note_details").select("rec_id", md.render_note(F.col("title"), F.col("body"), F.col("tags"), F.col("wiki_links"), {"source": source}).alias("note"))


def bucket_sql(n: str) -> str:
    return f"CASE WHEN ({n}) <= 0 THEN '0' ELSE CAST(CAST(pow(2, length(bin(CAST(({n}) AS BIGINT))) - 1) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pow(2, length(bin(CAST(({n}) AS BIGINT)))) AS BIGINT) AS VARCHAR) END"


@query(rf"""
WITH c AS (SELECT id, content, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS w, list_filter(string_split_regex(content, '\r\n|[\n\r]'), lambda x: regexp_matches(x, '\S')) AS f FROM notes)
SELECT id, substr(sha256(concat_ws('|', 'text', 'chars:' || {bucket_sql('length(content)')}, 'words:' || {bucket_sql('len(w)')},
 'lines:' || {bucket_sql("CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END")},
 'avg_line:' || {bucket_sql("CASE WHEN len(f) > 0 THEN CAST(list_sum(list_transform(f, lambda x: length(x))) AS BIGINT) // len(f) ELSE 0 END")},
 'paths:' || CASE WHEN regexp_matches(content, '[/\\]') THEN '1' ELSE '0' END, 'assign:' || CASE WHEN len(list_filter(list_slice(w, 1, 200), lambda x: contains(x, '='))) > 0 THEN '1' ELSE '0' END,
 'brackets:' || CASE WHEN regexp_matches(content, '[{{}}\[\]()]') THEN '1' ELSE '0' END, 'errors:' || CASE WHEN regexp_matches(lower(content), 'error|exception|traceback|failed|fatal') THEN '1' ELSE '0' END)), 1, 24) AS signature FROM c""")
def content_signature(spark, d):
    return _notes(spark, d).select("id", md.content_signature(F.col("content"), "text").alias("signature"))


@query(f"""WITH {BODY_SQL} SELECT n.id, n.title, array_to_string(n.tags, ',') AS tags, array_to_string(n.headings, ',') AS headings, array_to_string(n.wiki_links, ',') AS links, coalesce(b.body, '') AS body FROM notes n LEFT JOIN bodies b ON n.id = b.id""")
def note_detail(spark, d):
    return _notes(spark, d).select("id", "title", F.array_join("tags", ",").alias("tags"), F.array_join("headings", ",").alias("headings"), F.array_join("wiki_links", ",").alias("links"), md.body(F.col("content")).alias("body"))


# ---------------------------------------------------------------- graph

def _bucket_sql(name: str, column: str) -> str:
    return f"""{name}_t AS (SELECT DISTINCT id, unnest({column}) AS term FROM notes), {name}_k AS (SELECT term FROM {name}_t WHERE term IS NOT NULL GROUP BY term HAVING count(*) BETWEEN 2 AND 500),
{name} AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM {name}_t x JOIN {name}_t y ON x.term = y.term AND x.id < y.id WHERE x.term IN (SELECT term FROM {name}_k) GROUP BY x.id, y.id)"""


EDGES_SQL = f"""{_bucket_sql('tg', 'tags')}, {_bucket_sql('kw', 'keywords')},
lk_t AS (SELECT DISTINCT id AS src, unnest(wiki_links) AS dst FROM notes),
lk AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM lk_t WHERE dst IN (SELECT id FROM notes) GROUP BY 1, 2),
sig AS (SELECT a, b, n AS l, 0 AS t, 0 AS k FROM lk UNION ALL SELECT a, b, 0, n, 0 FROM tg UNION ALL SELECT a, b, 0, 0, n FROM kw),
pair AS (SELECT a, b, sum(l) AS l, sum(t) AS t, sum(k) AS k FROM sig GROUP BY a, b),
ty AS (SELECT ord, id AS src, unnest(map_keys(wiki_link_types)) AS dst, unnest(map_values(wiki_link_types)) AS type FROM notes),
de AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, first(type ORDER BY ord, src, dst) AS type FROM ty WHERE trim(type) <> '' GROUP BY 1, 2),
edges AS (SELECT p.a AS source, p.b AS target, CAST(5 * l + 2 * least(3, t) + least(5, k) AS INTEGER) AS weight,
  concat_ws(',', CASE WHEN k > 0 THEN 'shared_keywords' END, CASE WHEN t > 0 THEN 'shared_tags' END, CASE WHEN l > 0 THEN 'wiki_link' END) AS reasons,
  CASE WHEN l > 0 THEN coalesce(de.type, 'references') WHEN t > 0 THEN 'related_topic' ELSE 'similar_content' END AS relation_type FROM pair p LEFT JOIN de ON p.a = de.a AND p.b = de.b),
adj AS (SELECT source AS src, target AS dst, weight, reasons, relation_type FROM edges UNION ALL SELECT target, source, weight, reasons, relation_type FROM edges)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return relate.build_edges(_notes(spark, d))


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(cut(_edges(spark, d), "edges"))


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {EDGES_SQL} SELECT relation_type, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY relation_type")
def edge_relation_type(spark, d):
    return _edges(spark, d).groupBy("relation_type").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, weight, relation_type FROM adj")
def adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)).select("src", "dst", "weight", "relation_type")


@query(f"WITH {EDGES_SQL}, dg AS (SELECT src, count(*) AS degree FROM adj GROUP BY src) SELECT n.id, coalesce(dg.degree, 0) AS degree FROM notes n LEFT JOIN dg ON n.id = dg.src ORDER BY degree DESC, n.id LIMIT 10")
def most_connected(spark, d):
    notes = _notes(spark, d)
    return graph.degrees(notes, graph.adjacency(relate.build_edges(notes))).orderBy(F.col("degree").desc(), "id").limit(10)


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, d):
    tags = _notes(spark, d).select(F.explode("tags").alias("tag")).where("tag IS NOT NULL")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(10)


@query("SELECT id, title, CAST(least(10, importance) AS INTEGER) AS importance FROM notes WHERE importance > 0 ORDER BY importance DESC, ord")
def important_notes(spark, d):
    notes = _notes(spark, d).where("importance > 0").select("ord", "id", "title", retrieve.clamped(F.col("importance")).cast("int").alias("importance"))
    return notes.orderBy(F.col("importance").desc(), "ord").select("id", "title", "importance")


@query(f"""WITH {EDGES_SQL}, dg AS (SELECT src, count(*) AS n FROM adj GROUP BY src), hub AS (SELECT src || '=' || n AS x, n, src FROM dg ORDER BY n DESC, src LIMIT 10),
tc AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 10)
SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM edges) AS total_edges, (SELECT string_agg(x, ',' ORDER BY n DESC, src) FROM hub) AS most_connected,
(SELECT string_agg(tag || '=' || n, ',' ORDER BY n DESC, tag) FROM tc) AS top_tags, (SELECT count(*) FROM notes WHERE importance > 0) AS important, (SELECT count(*) FROM cache_entries WHERE embedding IS NOT NULL) > 0 AS semantic""")
def vault_summary(spark, d):
    notes = _notes(spark, d)
    edges = cut(relate.build_edges(notes), "edges")
    hubs = graph.adjacency(edges).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").limit(10)
    tags = notes.select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(10)

    def listed(best: DataFrame, name: str, alias: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(name).alias("x"))))  # ten rows
        return best.agg(F.array_join(F.transform(ordered, lambda r: F.concat(r["x"], F.lit("="), (-r["m"]).cast("string"))), ",").alias(alias))

    parts = [notes.agg(F.count("*").alias("total_notes"), F.count_if(F.col("importance") > 0).alias("important")), edges.agg(F.count("*").alias("total_edges")), listed(hubs, "src", "most_connected"), listed(tags, "tag", "top_tags"),
             table(spark, d, "cache_entries").where("embedding IS NOT NULL").agg((F.count("*") > 0).alias("semantic"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select("total_notes", "total_edges", "most_connected", "top_tags", "important", "semantic")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS id, dst AS neighbour FROM adj")
def backlinks(spark, d):
    return graph.backlinks(graph.adjacency(_edges(spark, d)))


@query("SELECT src, dst FROM (SELECT DISTINCT id AS src, unnest(wiki_links) AS dst FROM notes) WHERE dst NOT IN (SELECT id FROM notes)")
def dangling_links(spark, d):
    return relate.dangling_links(_notes(spark, d))


@query("SELECT id FROM notes ORDER BY id")
def list_notes(spark, d):
    return _notes(spark, d).select("id").orderBy("id")


@query("SELECT id, title AS label FROM notes")
def graph_nodes(spark, d):
    return _notes(spark, d).select("id", F.col("title").alias("label"))


@query(f"""WITH {EDGES_SQL}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM adj WHERE weight >= 3),
l1 AS (SELECT dst AS id, min(place) AS p FROM o WHERE src = '{START}' AND place <= 5 AND dst <> '{START}' GROUP BY dst), r1 AS (SELECT id, row_number() OVER (ORDER BY p) AS r FROM l1),
l2 AS (SELECT o.dst AS id, min(r1.r * 100 + o.place) AS p FROM o JOIN r1 ON o.src = r1.id WHERE o.place <= 5 AND o.dst <> '{START}' AND o.dst NOT IN (SELECT id FROM r1) GROUP BY o.dst),
r2 AS (SELECT id, row_number() OVER (ORDER BY p) + (SELECT count(*) FROM r1) AS r FROM l2)
SELECT id, CAST(1 AS INTEGER) AS depth, CAST(r AS INTEGER) AS rank FROM r1 UNION ALL SELECT id, 2, CAST(r AS INTEGER) FROM r2""")
def bfs_traverse(spark, d):
    return graph.traverse(_adjacent(spark, d), START, 2, 5, 3)


@query(f"""WITH RECURSIVE {EDGES_SQL}, bfs(id, n) AS (SELECT '{START}', 0 UNION SELECT adj.dst, bfs.n + 1 FROM bfs JOIN adj ON adj.src = bfs.id WHERE bfs.n < 4)
SELECT '{START}' AS source, '{END}' AS target, CAST(min(n) AS INTEGER) AS length FROM bfs WHERE id = '{END}' HAVING count(*) > 0""")
def shortest_path(spark, d):
    path = graph.find_path(_adjacent(spark, d), START, END)
    return path.agg(F.max("step").alias("length")).where("length IS NOT NULL").select(F.lit(START).alias("source"), F.lit(END).alias("target"), "length")


@query(f"""WITH RECURSIVE {EDGES_SQL}, bfs(id, n) AS (SELECT '{START}', 0 UNION SELECT adj.dst, bfs.n + 1 FROM bfs JOIN adj ON adj.src = bfs.id WHERE bfs.n < 4),
dist AS (SELECT id, min(n) AS n FROM bfs GROUP BY id), par AS (SELECT adj.dst AS id, dist.n + 1 AS n, min(adj.src) AS parent FROM adj JOIN dist ON dist.id = adj.src GROUP BY adj.dst, dist.n + 1),
back(step, id) AS (SELECT n, id FROM dist WHERE id = '{END}' UNION ALL SELECT back.step - 1, par.parent FROM back JOIN par ON par.id = back.id AND par.n = back.step WHERE back.step > 0)
SELECT CAST(step AS INTEGER) AS step, id FROM back""")
def shortest_path_notes(spark, d):
    return graph.find_path(_adjacent(spark, d), START, END)


@query(f"""WITH {EDGES_SQL}, u AS (SELECT DISTINCT * FROM adj)
SELECT s.id, s.title, u.dst AS neighbour, coalesce(t.title, u.dst) AS neighbour_title, u.weight, u.relation_type, u.reasons, CAST(row_number() OVER (PARTITION BY u.src ORDER BY u.weight DESC, u.dst) AS INTEGER) AS place
FROM u JOIN notes s ON s.id = u.src LEFT JOIN notes t ON t.id = u.dst""")
def note_context(spark, d):
    notes = _notes(spark, d)
    return graph.contexts(notes, relate.build_edges(notes))


@query(f"""WITH {EDGES_SQL} SELECT 'node' AS kind, id AS a, '' AS b, title AS label, CAST(0 AS INTEGER) AS weight FROM notes UNION ALL SELECT 'edge', source, target, relation_type, weight FROM edges""")
def graph_export_fields(spark, d):
    """The fields of the exported JSON lines, read back from them."""
    notes = _notes(spark, d)
    x = lambda p: F.get_json_object("json", f"$.{p}")
    lines = graph.graph_json(notes, relate.build_edges(notes))
    return lines.select("kind", F.coalesce(x("id"), x("source")).alias("a"), F.coalesce(x("target"), F.lit("")).alias("b"), F.coalesce(x("label"), x("relationType")).alias("label"), F.coalesce(x("weight").cast("int"), F.lit(0)).alias("weight"))


@query()
def graph_export(spark, d):
    notes = _notes(spark, d)
    return graph.graph_json(notes, relate.build_edges(notes))


# ---------------------------------------------------------------- retrieval

INDEX_SQL = rf"""
fields AS (SELECT id, 'title' AS field, title AS v FROM notes UNION ALL SELECT id, 'headings', array_to_string(headings, ' ') FROM notes UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM notes
  UNION ALL SELECT id, 'folder', {FOLDER_SQL} FROM notes UNION ALL SELECT id, 'content', content FROM notes),
tok AS (SELECT id, field, regexp_extract_all(lower(v), '[\p{{L}}\p{{N}}]+') AS t FROM fields WHERE coalesce(trim(v), '') <> ''), tk AS (SELECT * FROM tok WHERE len(t) > 0),
stats AS (SELECT field, count(*) AS docs, avg(len(t)) AS avgdl FROM tk GROUP BY field),
post AS (SELECT field, term, id, dl, count(*) AS tf FROM (SELECT field, id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY field, term, id, dl),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term)"""


def keyword_sql(name: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{name} AS (SELECT p.id, round(sum(CASE p.field WHEN 'title' THEN 3.0 WHEN 'content' THEN 1.0 ELSE 2.0 END::DOUBLE * ln(1.0 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * p.tf / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))), 9) AS score
  FROM post p JOIN dfs f ON p.field = f.field AND p.term = f.term JOIN stats s ON s.field = p.field WHERE p.term IN ({listed}) GROUP BY p.id HAVING count(DISTINCT p.term) = {len(words)})"""


@query(f"WITH {INDEX_SQL} SELECT s.field, CAST(s.docs AS BIGINT) AS docs, round(s.avgdl, 6) AS avgdl, f.term, CAST(f.df AS BIGINT) AS df FROM stats s JOIN dfs f ON s.field = f.field")
def bm25_stats(spark, d):
    index = _index(spark, d)
    return index.frequency.join(F.broadcast(index.stats), "field").select("field", "docs", F.round("avgdl", 6).alias("avgdl"), "term", "df")  # five fields


def _index(spark: SparkSession, d: str) -> retrieve.Index:
    return retrieve.stored_index(_notes(spark, d), f"{shared_dir(spark)}/lorevine")


def _keyword(spark: SparkSession, d: str, text: str) -> DataFrame:
    return retrieve.keyword_scores(_index(spark, d), text)


@query(f"WITH {INDEX_SQL}, {keyword_sql('kw', QUERY.split())} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM kw ORDER BY score DESC, id LIMIT 20")
def keyword_search(spark, d):
    return retrieve.top(_keyword(spark, d, QUERY), 20).select("rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {INDEX_SQL}, hit AS (SELECT DISTINCT id FROM post WHERE term = 'gateway' AND field = 'content' INTERSECT SELECT DISTINCT id FROM post WHERE starts_with(term, 'budg')),
bad AS (SELECT DISTINCT id FROM post WHERE term = 'archive') SELECT id FROM hit WHERE id NOT IN (SELECT id FROM bad)""")
def keyword_syntax(spark, d):
    return _keyword(spark, d, "content:gateway budg* -archive").select("id")


HAS_SQL = "(SELECT DISTINCT id FROM post WHERE term = '{}')"


@query(f"""WITH {INDEX_SQL}, one AS {HAS_SQL.format('gateway')}, two AS {HAS_SQL.format('budget')}, all_of AS {HAS_SQL.format('index')}, bad AS {HAS_SQL.format('archive')}
SELECT id FROM (SELECT id FROM one UNION SELECT id FROM two) WHERE id IN (SELECT id FROM all_of) AND id NOT IN (SELECT id FROM bad)""")
def keyword_group(spark, d):
    return _keyword(spark, d, "(gateway OR budget) AND index NOT archive").select("id")


@query(f"""WITH {INDEX_SQL} SELECT DISTINCT id FROM tk WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' the budget ') UNION
SELECT id FROM post WHERE term BETWEEN 'gatew' AND 'gatez' AND field = 'title'""")
def keyword_phrase(spark, d):
    return _keyword(spark, d, '"the budget" OR title:[gatew TO gatez]').select("id")


@query(f"WITH {INDEX_SQL}, {keyword_sql('kw', ['für'])}, {keyword_sql('ru', ['для'])} SELECT id, round(coalesce(kw.score, 0) + coalesce(ru.score, 0), 6) AS score FROM kw FULL JOIN ru USING (id)")
def keyword_unicode(spark, d):
    return _keyword(spark, d, "für OR Для").select("id", F.round("score", 6).alias("score"))


USABLE_SQL = "len(v) = 96 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
VECTOR_SQL = f"""
raw_v AS (SELECT entry_id, id, embedding AS v FROM cache_entries), good_v AS (SELECT entry_id, id, CAST(v AS DOUBLE[]) AS v FROM raw_v WHERE {USABLE_SQL}),
qv AS (SELECT v FROM good_v ORDER BY entry_id LIMIT 1),
vs AS (SELECT entry_id, id, round((1 + list_dot_product(good_v.v, qv.v) / (sqrt(list_dot_product(good_v.v, good_v.v)) * sqrt(list_dot_product(qv.v, qv.v)))) / 2, 9) AS score FROM good_v, qv),
sem AS (SELECT id, max(score) AS score FROM vs WHERE id IS NOT NULL GROUP BY id)"""


def _entry_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cache_entries").select("entry_id", "id", F.col("embedding").alias("v")).where(retrieve.usable(F.col("v"), 96))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(_entry_vectors(spark, d).orderBy("entry_id").first().v)


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    scored = retrieve.vector_scores(_entry_vectors(spark, d), _query_vector(spark, d))
    return scored.where("id IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))


@query(f"WITH {VECTOR_SQL} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM sem ORDER BY score DESC, id LIMIT 10")
def semantic_search(spark, d):
    return retrieve.top(_semantic(spark, d), 10).select("rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTOR_SQL} SELECT entry_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS value FROM good_v")
def l2_normalize(spark, d):
    return _entry_vectors(spark, d).select("entry_id", F.posexplode(retrieve.l2_normalized(F.col("v"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {VECTOR_SQL} SELECT id, pos, round(avg(value), 6) AS value FROM (SELECT id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS value FROM good_v WHERE id IS NOT NULL) GROUP BY id, pos")
def mean_pool(spark, d):
    return retrieve.mean_pool(_entry_vectors(spark, d).where("id IS NOT NULL"), "id", "v").withColumn("value", F.round("value", 6))


BOOST_SQL = f"""
acc AS (SELECT id, count(*) AS accesses, epoch_us(max(ts)) // 1000 AS last_ms FROM access_log WHERE id IS NOT NULL GROUP BY id),
boosts AS (SELECT n.id, greatest(0, least(10, coalesce(n.importance, 0))) * 0.01::DOUBLE + CASE WHEN last_ms > 0 THEN greatest(0.0, 0.05::DOUBLE * (1.0 - ({NOW_MS} - last_ms) / 604800000.0::DOUBLE)) ELSE 0.0 END AS boost, accesses FROM notes n LEFT JOIN acc ON n.id = acc.id)"""


def _boosts(spark: SparkSession, d: str) -> DataFrame:
    joined = _notes(spark, d).select("id", "importance").join(retrieve.access_stats(table(spark, d, "access_log")), "id", "left")
    return joined.select("id", retrieve.metadata_boost(retrieve.clamped(F.col("importance")), F.col("last_ms"), NOW_MS).alias("boost"), "accesses")


@query(f"WITH {BOOST_SQL} SELECT id, round(boost, 6) AS boost, coalesce(accesses, 0) AS accesses FROM boosts")
def metadata_boost(spark, d):
    return _boosts(spark, d).select("id", F.round("boost", 6).alias("boost"), F.coalesce("accesses", F.lit(0)).cast("long").alias("accesses"))


def hybrid_sql(k: int) -> str:
    return f"""{INDEX_SQL}, {keyword_sql('kw', QUERY.split())}, {VECTOR_SQL}, {BOOST_SQL},
k2 AS (SELECT id, score FROM kw ORDER BY score DESC, id LIMIT {2 * k}), s2 AS (SELECT id, score FROM sem ORDER BY score DESC, id LIMIT {2 * k}),
fu AS (SELECT id, sum(p) AS score FROM (SELECT id, score / (SELECT max(score) FROM k2) * 0.2::DOUBLE AS p FROM k2 UNION ALL SELECT id, score / (SELECT max(score) FROM s2) * 0.8::DOUBLE FROM s2) GROUP BY id),
hy AS (SELECT id, round(fu.score + coalesce(b.boost, 0), 9) AS score FROM fu LEFT JOIN boosts b USING (id)),
ranked AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM hy QUALIFY rank <= {k})"""


def _hybrid(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.hybrid(_keyword(spark, d, QUERY), _semantic(spark, d), _boosts(spark, d).select("id", "boost"), k)


@query(f"WITH {hybrid_sql(10)} SELECT CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM ranked")
def hybrid_search(spark, d):
    return _hybrid(spark, d, 10).withColumn("score", F.round("score", 6))


OVERLAP_WORDS = sorted(set(QUESTION.split()))
OVERLAP_SQL = rf"len(list_filter([{', '.join(repr(w) for w in OVERLAP_WORDS)}], lambda w: list_contains(regexp_extract_all(lower(concat_ws(' ', title, substr(coalesce(content, ''), 1, 512))), '[\p{{L}}\p{{N}}]+'), w))) / {float(len(OVERLAP_WORDS))}::DOUBLE"


@query(f"WITH {hybrid_sql(40)}, re AS (SELECT n.id, {OVERLAP_SQL} AS score FROM ranked JOIN notes n ON n.id = ranked.id) SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM re ORDER BY score DESC, id LIMIT 10")
def reranked_search(spark, d):
    hits = _hybrid(spark, d, 40)
    return retrieve.rerank(hits, _notes(spark, d), QUESTION, 10).withColumn("score", F.round("score", 6))


CHUNK_SQL = f"""
{VECTOR_SQL}, raw_c AS (SELECT entry_id, id, unnest(chunk_embeddings) AS v, unnest(range(len(chunk_embeddings))) AS chunk_index FROM cache_entries WHERE id IS NOT NULL),
good_c AS (SELECT entry_id, id, chunk_index, CAST(v AS DOUBLE[]) AS v FROM raw_c WHERE {USABLE_SQL}),
cs AS (SELECT id, CAST(chunk_index AS INTEGER) AS chunk_index, max(round((1 + list_dot_product(c.v, qv.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(qv.v, qv.v)))) / 2, 9)) AS score FROM good_c c, qv GROUP BY id, chunk_index),
ch AS (SELECT row_number() OVER (ORDER BY score DESC, id, chunk_index) AS r, * FROM cs QUALIFY r <= 20)"""


def _chunk_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "cache_entries").where("id IS NOT NULL").select("id", F.posexplode("chunk_embeddings").alias("chunk_index", "v"))
    scored = retrieve.vector_scores(rows.where(retrieve.usable(F.col("v"), 96)), _query_vector(spark, d)).groupBy("id", "chunk_index").agg(F.max("score").alias("score"))
    return retrieve.top(scored, k, ["id", "chunk_index"])


@query(f"WITH {CHUNK_SQL} SELECT CAST(r AS INTEGER) AS rank, id, chunk_index, round(score, 6) AS score FROM ch")
def chunk_search(spark, d):
    return _chunk_hits(spark, d, 20).select("rank", "id", "chunk_index", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNK_SQL} SELECT id, CAST(min(r) AS INTEGER) AS first_rank, floor(max(score) * 100 + 0.5) / 100 AS score, string_agg(chunk_index, ',' ORDER BY r) AS chunks FROM ch GROUP BY id")
def ask_vault(spark, d):
    grouped = retrieve.group_chunks(_chunk_hits(spark, d, 20).select("id", "chunk_index", "score"))
    return grouped.select("id", "first_rank", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"), F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


CHARS_SQL = "list_filter(string_split_regex({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(rf"""WITH {CHUNK_SQL}, {CHUNKS_SQL}, hit AS (SELECT ch.r, ch.id, regexp_replace(regexp_replace(regexp_replace(c.text, '(?i)\b(?:{'|'.join(md.FILTER_STOP_WORDS)})\b', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), {TRIM}) AS text FROM ch JOIN chunks c ON c.id = ch.id AND c.chunk_index = ch.chunk_index),
kp AS (SELECT *, list_filter({CHARS_SQL.format('text')}, lambda w: least(1.0, length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) / 12.0::DOUBLE) > 0.5) AS kept FROM hit),
sh AS (SELECT r, id, CASE WHEN length(text) < 300 OR len({CHARS_SQL.format('text')}) < 10 OR len(kept) = 0 THEN text ELSE array_to_string(kept, ' ') END AS text FROM kp)
SELECT id, CAST(min(r) AS INTEGER) AS first_rank, string_agg(text, chr(10) || chr(10) ORDER BY r) AS passages FROM sh GROUP BY id""")
def ask_vault_passages(spark, d):
    """The texts of the chunks found, by note in order of rank: without stop words, long ones compressed; chunks that the note has no text for are passed over."""
    hits = _chunk_hits(spark, d, 20).join(chunks(_notes(spark, d)), ["id", "chunk_index"])
    shown = hits.select("id", "rank", compress.compress_long(md.strip_stop_words(F.col("text"))).alias("text"))
    passages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")  # of at most 20 hits
    return shown.groupBy("id").agg(F.min("rank").alias("first_rank"), passages.alias("passages"))


@query(f"WITH {hybrid_sql(5)} SELECT r.id, floor(score * 100 + 0.5) / 100 AS score, substr(n.content, 1, 600) AS excerpt FROM ranked r JOIN notes n ON n.id = r.id")
def gather_sources(spark, d):
    return _hybrid(spark, d, 5).join(_notes(spark, d).select("id", "content"), "id").select("id", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"), F.substring("content", 1, 600).alias("excerpt"))


@query(f"WITH {hybrid_sql(20)} SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.70 THEN 'duplicate' WHEN score >= 0.40 THEN 'overlap' ELSE 'new' END AS band FROM ranked")
def duplicate_band(spark, d):
    band = F.when(F.col("score") >= 0.70, "duplicate").when(F.col("score") >= 0.40, "overlap").otherwise("new")
    return _hybrid(spark, d, 20).select("id", F.round("score", 6).alias("score"), band.alias("band"))


@query(f"WITH {hybrid_sql(10)} SELECT id FROM ranked WHERE score >= 0.35 ORDER BY rank LIMIT 1")
def near_duplicate(spark, d):
    return _hybrid(spark, d, 10).where("score >= 0.35").orderBy("rank").limit(1).select("id")


AUTO_SQL = f"""{INDEX_SQL}, {keyword_sql('kw', QUERY.split())}, hit AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS r, id, score FROM kw QUALIFY r <= 5),
ex AS (SELECT wiki_links AS l FROM notes WHERE id = '{START}'), ok AS (SELECT id, r FROM hit WHERE score >= 0.3 AND id <> '{START}')"""


def _autolinked(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.top(_keyword(spark, d, QUERY), 5).select(F.lit(START).alias("id"), F.col("id").alias("other"), "score", "rank")
    return mutate.autolinks(_notes(spark, d).where(F.col("id") == START).select("id", F.col("wiki_links").alias("links")), hits)


@query(f"WITH {AUTO_SQL} SELECT '{START}' AS id, array_to_string(list_sort(list_distinct(list_concat((SELECT l FROM ex), (SELECT list(id) FROM ok)))), ',') AS links")
def autolink_union(spark, d):
    return _autolinked(spark, d).select("id", F.array_join(F.array_sort("all_links"), ",").alias("links"))


@query(f"WITH {AUTO_SQL} SELECT '{START}' AS id, coalesce((SELECT string_agg(ok.id, ',' ORDER BY ok.r) FROM ok, ex WHERE NOT list_contains(ex.l, ok.id)), '') AS links")
def autolink_new(spark, d):
    return _autolinked(spark, d).select("id", F.array_join("new_links", ",").alias("links"))


@query(rf"""WITH {INDEX_SQL}, {BODY_SQL},
qw AS (SELECT n.id AS src, unnest(regexp_extract_all(lower(coalesce(n.title, '') || ' ' || substr(coalesce(b.body, ''), 1, 500)), '[\p{{L}}\p{{N}}]+')) AS term FROM notes n LEFT JOIN bodies b ON n.id = b.id),
qt AS (SELECT src, term, count(*) AS times FROM qw GROUP BY src, term), need AS (SELECT src, count(*) AS n FROM qt GROUP BY src),
sc AS (SELECT qt.src, p.id, count(DISTINCT p.term) AS m, round(sum(qt.times * CASE p.field WHEN 'title' THEN 3.0 WHEN 'content' THEN 1.0 ELSE 2.0 END::DOUBLE * ln(1.0 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * p.tf / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))), 9) AS score
  FROM qt JOIN post p ON p.term = qt.term JOIN dfs f ON p.field = f.field AND p.term = f.term JOIN stats s ON s.field = p.field GROUP BY qt.src, p.id),
hit AS (SELECT sc.src, sc.id, score, row_number() OVER (PARTITION BY sc.src ORDER BY score DESC, sc.id) AS r FROM sc JOIN need ON sc.src = need.src WHERE m = n QUALIFY r <= 5),
ok AS (SELECT src, list(id ORDER BY r) AS f FROM hit WHERE score >= 0.3 AND id <> src GROUP BY src)
SELECT n.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(n.wiki_links, []), coalesce(f, [])))), ',') AS links,
  array_to_string(list_filter(coalesce(f, []), lambda x: NOT coalesce(list_contains(n.wiki_links, x), false)), ',') AS new_links FROM notes n LEFT JOIN ok ON n.id = ok.src""")
def auto_links(spark, d):
    """Links of every note, given and found from its own text."""
    notes = _notes(spark, d)
    queries = notes.select(F.col("id").alias("src"), retrieve.link_query(F.col("title"), md.body(F.col("content"))).alias("text"))
    hits = retrieve.note_links(notes, queries, 5).select(F.col("src").alias("id"), F.col("id").alias("other"), "score", "rank")
    linked = mutate.autolinks(notes.select("id", F.col("wiki_links").alias("links")), hits)
    return linked.select("id", F.array_join(F.array_sort("all_links"), ",").alias("links"), F.array_join("new_links", ",").alias("new_links"))


@query("SELECT query_id, id, CAST(count(DISTINCT list_name) AS BIGINT) AS lists, CAST(min(list_rank) AS INTEGER) AS best_rank FROM search_results WHERE id IS NOT NULL GROUP BY query_id, id")
def multi_list_merge(spark, d):
    return table(spark, d, "search_results").where("id IS NOT NULL").groupBy("query_id", "id").agg(F.countDistinct("list_name").alias("lists"), F.min("list_rank").alias("best_rank"))


# ---------------------------------------------------------------- compression

SCORE_SQL = "least(1.0, length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) / 12.0::DOUBLE)"
WORDS_SQL = r"ws AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, source FROM documents)"
KEPT_SQL = f"{WORDS_SQL}, kept AS (SELECT *, list_filter(ws, lambda w: {SCORE_SQL} > 0.5) AS k FROM ws), done AS (SELECT *, CASE WHEN len(ws) < 10 OR len(k) = 0 THEN text ELSE array_to_string(k, ' ') END AS c FROM kept)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"WITH {KEPT_SQL} SELECT doc_id, c AS compressed FROM done")
def compress_threshold(spark, d):
    return _documents(spark, d).select("doc_id", compress.compress_threshold(F.col("text")).alias("compressed"))


@query(f"""WITH {hybrid_sql(5)}, gx AS (SELECT r.id, score, substr(coalesce(n.content, ''), 1, 600) AS x FROM ranked r JOIN notes n ON n.id = r.id),
gw AS (SELECT *, list_filter(string_split_regex(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM gx), gk AS (SELECT *, list_filter(ws, lambda w: {SCORE_SQL} > 0.5) AS kept FROM gw)
SELECT id, floor(score * 100 + 0.5) / 100 AS score, CASE WHEN length(x) < 300 OR len(ws) < 10 OR len(kept) = 0 THEN x ELSE array_to_string(kept, ' ') END AS excerpt FROM gk""")
def gather_compressed(spark, d):
    """The sources of ``gather_sources`` with their excerpts compressed, short ones as they are."""
    hits = _hybrid(spark, d, 5).join(_notes(spark, d).select("id", md.text(F.col("content")).alias("content")), "id")
    return hits.select("id", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"), compress.compress_long(F.substring("content", 1, 600)).alias("excerpt"))


@query(f"""WITH {WORDS_SQL}, x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM ws), s AS (SELECT *, i // 350 AS win, {SCORE_SQL} AS s FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY s DESC, i) AS r, count(*) OVER (PARTITION BY doc_id, win) AS n FROM s),
o AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM r WHERE r <= greatest(1, floor(n * 0.6::DOUBLE)) GROUP BY doc_id)
SELECT ws.doc_id, CASE WHEN len(ws) < 10 THEN text ELSE o.c END AS compressed FROM ws LEFT JOIN o ON ws.doc_id = o.doc_id""")
def compress_topk(spark, d):
    return _documents(spark, d).select("doc_id", compress.compress_share(F.col("text"), 0.6).alias("compressed"))


@query(f"WITH {KEPT_SQL}, t AS (SELECT doc_id, CAST(len(ws) AS INTEGER) AS o, CAST(len(list_filter(string_split_regex(c, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS INTEGER) AS n FROM done) SELECT doc_id, o AS original_tokens, n AS compressed_tokens, greatest(0, o - n) AS tokens_saved, round(CASE WHEN o > 0 THEN greatest(0, o - n) / o * 100.0::DOUBLE ELSE 0 END, 6) AS savings_percentage FROM t")
def compression_savings(spark, d):
    cols = compress.savings(F.col("text"), F.col("c"))
    done = _documents(spark, d).select("doc_id", "text", compress.compress_threshold(F.col("text")).alias("c"))
    return done.select("doc_id", *[(F.round(cols[n], 6) if n == "savings_percentage" else cols[n]).alias(n) for n in ("original_tokens", "compressed_tokens", "tokens_saved", "savings_percentage")])


@query(rf"""WITH w AS (SELECT id, word, pos FROM (SELECT id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+')) AS word, generate_subscripts(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), 1) - 1 AS pos FROM notes)),
t AS (SELECT id, pos, unnest(list_transform(range(0, CAST(ceil(length(word) / 4.0) AS BIGINT)), lambda i: substr(word, CAST(i AS BIGINT) * 4 + 1, 4))) AS piece FROM w)
SELECT id, CAST(pos AS INTEGER) AS word_id, round(max(least(1.0, length(regexp_replace(piece, '[^A-Za-z0-9]', '', 'g')) / 12.0::DOUBLE)), 6) AS score FROM t GROUP BY id, pos""")
def token_word_max(spark, d):
    """Scores of words from scores of their pieces of four characters."""
    words = _notes(spark, d).select("id", F.posexplode(retrieve.terms(F.col("title"))).alias("word_id", "word"))
    pieces = words.select("id", "word_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("word") / 4).cast("int") - 1), lambda i: F.substr("word", i * 4 + 1, F.lit(4)))).alias("piece"))
    return compress.word_max(pieces.select("id", "word_id", compress.length_score(F.col("piece")).alias("score")), ["id"]).withColumn("score", F.round("score", 6))


ROLE_SQL = "CASE WHEN starts_with(coalesce(source, ''), 'agent') THEN 'assistant' WHEN starts_with(coalesce(source, ''), 'export') THEN 'tool' ELSE 'user' END"


def _role():
    source = F.coalesce("source", F.lit(""))
    return F.when(F.startswith(source, F.lit("agent")), "assistant").when(F.startswith(source, F.lit("export")), "tool").otherwise("user")


@query(f"WITH {KEPT_SQL} SELECT doc_id, {ROLE_SQL} AS role, CASE WHEN {ROLE_SQL} <> 'user' AND len(ws) >= 10 AND len(list_filter(string_split_regex(c, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) / len(ws)::DOUBLE < 0.9 THEN c ELSE text END AS message FROM done")
def compress_messages(spark, d):
    return _documents(spark, d).select("doc_id", _role().alias("role"), F.coalesce(compress.compress_messages(_role(), F.col("text")), F.lit("")).alias("message"))


@query(f"WITH {WORDS_SQL} SELECT {ROLE_SQL} AS role, CAST(sum(len(ws)) AS BIGINT) AS tokens FROM ws GROUP BY 1")
def conversation_tokens(spark, d):
    return _documents(spark, d).groupBy(_role().alias("role")).agg(F.sum(F.size(compress.split_words(F.col("text")))).alias("tokens"))


@query(f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{'|'.join(md.REFLECTION_PHRASES)}') AS reflection FROM documents")
def intent_class(spark, d):
    return _documents(spark, d).select("doc_id", md.reflection_intent(F.col("text")).alias("reflection"))


@query(f"""WITH {KEPT_SQL}, t AS (SELECT doc_id, text, c, len(ws) AS o, len(list_filter(string_split_regex(c, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM done)
SELECT doc_id, CASE WHEN o > 0 AND n / o::DOUBLE < 0.8 THEN c || chr(10) || '[' || o || ' items compressed to ' || n || '. Retrieve more: hash=' || substr(sha256(text), 1, 24) || ']' ELSE c END AS marked FROM t""")
def compress_marked(spark, d):
    return _documents(spark, d).select("doc_id", compress.marked(F.col("text"), compress.compress_threshold(F.col("text"))).alias("marked"))


# ---------------------------------------------------------------- incremental

@query("""SELECT DISTINCT f.id FROM (SELECT id, max(modified_ms) AS m FROM note_changes WHERE id IS NOT NULL GROUP BY id) f LEFT JOIN (SELECT id, max(last_modified) AS c FROM cache_entries GROUP BY id) c ON f.id = c.id WHERE c.c IS NULL OR c.c < f.m""")
def modified_notes(spark, d):
    files = table(spark, d, "note_changes").where("id IS NOT NULL").groupBy("id").agg(F.max("modified_ms").alias("modified_ms"))
    return mutate.modified(files, table(spark, d, "cache_entries").select("id", F.col("last_modified").alias("modified_ms")))


LATEST_SQL = """latest AS (SELECT id, upper(trim(op)) AS op, content FROM note_changes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_ms DESC NULLS LAST, change_id DESC) = 1)"""


@query(f"WITH {LATEST_SQL} SELECT n.id, n.content FROM notes n WHERE n.id NOT IN (SELECT id FROM latest) UNION ALL SELECT id, content FROM latest WHERE op <> 'DELETE'")
def incremental_merge(spark, d):
    changes = table(spark, d, "note_changes")
    key = F.struct("modified_ms", "change_id")
    last = changes.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.upper(F.trim("op")), key).alias("op"), F.max_by("content", key).alias("content"))
    return mutate.merge(_notes(spark, d).select("id", "content"), last.where("op <> 'DELETE'").select("id", "content"), last.where("op = 'DELETE'").select("id"))


@query("""WITH s AS (SELECT id, batch_no, sha256(coalesce(body, '')) AS h FROM note_details), a AS (SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS r FROM (SELECT id, sha256(coalesce(body, '')) AS h, rec_id FROM note_details WHERE batch_no <= 3)) WHERE r = 1),
b AS (SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS r FROM (SELECT id, sha256(coalesce(body, '')) AS h, rec_id FROM note_details WHERE batch_no >= 1)) WHERE r = 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'CREATE' WHEN b.id IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS op FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.h <> b.h""")
def snapshot_diff(spark, d):
    details = table(spark, d, "note_details")

    def state(condition: str) -> DataFrame:
        return details.where(condition).groupBy("id").agg(F.max_by("body", "rec_id").alias("content")).withColumn("modified_ms", F.lit(0).cast("long"))

    return mutate.snapshot_diff(state("batch_no <= 3"), state("batch_no >= 1"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 43200000 THEN 0 ELSE 1 END AS n FROM e),
s AS (SELECT user_id, ms, sum(n) OVER (PARTITION BY user_id ORDER BY ms) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS events FROM s GROUP BY user_id, session""")
def debounce_sessions(spark, d):
    return mutate.debounced(table(spark, d, "events"), "user_id", "ts", 43_200_000)


@query("""SELECT id, upper(trim(op)) AS op, CAST(modified_ms AS BIGINT) AS modified_ms FROM note_changes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_ms DESC NULLS LAST, change_id DESC) = 1""")
def latest_state(spark, d):
    return latest_changes(table(spark, d, "note_changes")).select("id", "op", "modified_ms")


# ---------------------------------------------------------------- models

@query()
def bert_pretokenize(spark, d):
    return models.pretokenized(_documents(spark, d), "doc_id", "text").select(F.col("key").alias("doc_id"), F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query()
def hashed_embedding(spark, d):
    return models.embed(_notes(spark, d).select("id", md.embed_text(F.col("title"), F.col("content")).alias("text")), "id", "text").select(F.col("key").alias("id"), "embedding")


@query(rf"""
WITH p AS (SELECT id, lower(regexp_replace(regexp_replace(regexp_replace({NOCODE}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[\[([^\]|]*)(?:\|[^\]]*)?\]\]', '\1', 'g'), '[#*_~>|\[\](){{}}]', ' ', 'g')) AS t FROM notes),
w AS (SELECT id, unnest(regexp_extract_all(t, '[a-zA-Z]{{3,}}')) AS word FROM p), k AS (SELECT id, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in md.KEYWORD_STOP_WORDS)}) GROUP BY id, word),
r AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS r FROM k) SELECT id, string_agg(word, ',' ORDER BY r) AS keywords FROM r WHERE r <= 15 GROUP BY id""")
def keyword_lists(spark, d):
    return keywords(_notes(spark, d)).select("id", F.array_join("keywords", ",").alias("keywords"))


# ---------------------------------------------------------------- caches and writers


@query(f"""WITH {LATEST_SQL.replace("SELECT id, upper(trim(op)) AS op, content", "SELECT id, upper(trim(op)) AS op, modified_ms")},
c AS (SELECT id, max(last_modified) AS m FROM cache_entries WHERE embedding IS NOT NULL AND chunk_embeddings IS NOT NULL AND last_modified IS NOT NULL GROUP BY id)
SELECT l.id, c.m IS NOT NULL AND c.m >= l.modified_ms AS usable FROM latest l LEFT JOIN c ON l.id = c.id WHERE l.op <> 'DELETE'""")
def cache_usable(spark, d):
    """Which notes need no new vectors: a cached entry with both kinds that is not older."""
    last = latest_changes(table(spark, d, "note_changes")).where("op <> 'DELETE'")
    cached = table(spark, d, "cache_entries").where("embedding IS NOT NULL AND chunk_embeddings IS NOT NULL AND last_modified IS NOT NULL").groupBy("id").agg(F.max("last_modified").alias("m"))
    return last.join(cached, "id", "left").select("id", F.coalesce(F.col("m") >= F.col("modified_ms"), F.lit(False)).alias("usable"))


@query(f"WITH {VECTOR_SQL} SELECT id FROM notes WHERE id NOT IN (SELECT id FROM good_v WHERE id IS NOT NULL)")
def missing_embeddings(spark, d):
    """Notes that the embedding job still has to take."""
    return _notes(spark, d).select("id").join(_entry_vectors(spark, d).where("id IS NOT NULL").select("id"), "id", "left_anti")


@query("SELECT id, title AS label FROM notes ORDER BY label, id")
def notes_by_label(spark, d):
    return _notes(spark, d).select("id", F.col("title").alias("label")).orderBy("label", "id")


@query(rf"""WITH t AS (SELECT rec_id, 'team/' || split_part(id, '/', 1) || '/' || regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS target FROM note_details WHERE batch_no >= 1)
SELECT t.rec_id, t.target, CASE WHEN n.id IS NULL THEN 'create' ELSE 'update' END AS action FROM t LEFT JOIN (SELECT DISTINCT 'team/' || id AS id FROM notes) n ON t.target = n.id""")
def upload_plan(spark, d):
    """Where an upload of each new record would go, and whether it creates or updates."""
    target = F.concat(F.lit("team/"), F.split_part("id", F.lit("/"), F.lit(1)), F.lit("/"), slugify(F.coalesce("title", F.lit(""))), F.lit(".md"))
    new = table(spark, d, "note_details").where("batch_no >= 1").select("rec_id", target.alias("target"))
    known = _notes(spark, d).select(F.concat(F.lit("team/"), F.col("id")).alias("target"), F.lit(1).alias("known")).distinct()
    return new.join(known, "target", "left").select("rec_id", "target", F.when(F.col("known").isNull(), "create").otherwise("update").alias("action"))


@query(r"""SELECT rec_id, array_to_string(list_transform(list_filter(regexp_extract_all(coalesce(body, ''), '(?:^|[^\w/])#([a-zA-Z][a-zA-Z0-9_-]*)', 1), lambda x: TRUE), lambda x: lower(x)), ' ') AS tags,
array_to_string(list_transform(regexp_extract_all(coalesce(body, ''), '\[\[([^\]\|\n]+)(?:\|[^\]\n]*)?\]\]', 1), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.md'), ' ') AS links FROM note_details""")
def writer_extraction(spark, d):
    """Tags (repeats kept) and slugged links of a body as a writer takes them."""
    body = md.text(F.col("body"))
    tags = F.transform(F.regexp_extract_all(body, F.lit(r"(?<![\w/])#([a-zA-Z][a-zA-Z0-9_-]*)"), F.lit(1)), F.lower)
    links = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]\|\n]+)(?:\|[^\]\n]*)?\]\]"), F.lit(1)), lambda x: F.concat(slugify(x), F.lit(".md")))
    return table(spark, d, "note_details").select("rec_id", F.array_join(tags, " ").alias("tags"), F.array_join(links, " ").alias("links"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS accesses, strftime(max(ts), '%Y-%m-%d') AS last_day FROM access_log WHERE id IS NOT NULL GROUP BY id")
def access_counts(spark, d):
    return table(spark, d, "access_log").where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("accesses"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))
