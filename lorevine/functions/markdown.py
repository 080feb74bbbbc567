"""Extraction from Markdown notes as Column expressions; null content counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorevine.functions.ids import normalize_id, trim_control

# Words that are never keywords.
KEYWORD_STOP_WORDS = (
    "the and for are but not you all can her was one our out day get has him his how its may new now old see two who did she use way will with this that they from have "
    "been more also into then than when which each just like some time very what know take come made over such your well only even back after first these being there "
    "their other about where could would should those while much many data using used make makes need needs work works note notes file files http https www"
).split()
# Words that the stop-word filter removes.
FILTER_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# Phrases that mark a request for reflection.
REFLECTION_PHRASES = (
    "summarize", "summarise", "synthesize", "synthesise", "weekly review", "generate report", "write a summary", "overview of", "compile a", "reflect on", "reflection", "roundup", "digest",
)
MAX_KEYWORDS = 15
LEAST_PARAGRAPH = 50

_FENCED = r"(?s)```.*?```"
_INLINE = r"`[^`]+`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(content: Column) -> Column:
    """Lines split at any line end."""
    return F.split(text(content), r"\r\n|\r|\n")


def title(note_id: Column, content: Column) -> Column:
    """First ``# `` heading of the first 25 lines outside the block between the first two ``---`` lines; else the file name without ``.md``."""
    def step(acc: Column, line: Column) -> Column:
        found = acc["title"].isNull() & (acc["fm"] != 1) & F.startswith(line, F.lit("# "))
        rule = (acc["fm"] < 2) & (line == "---")
        return F.struct((acc["fm"] + rule.cast("int")).alias("fm"), F.when(found, trim_control(F.substr(line, F.lit(3)))).otherwise(acc["title"]).alias("title"))

    # fm counts the rules seen: one means inside the front matter
    start = F.struct(F.lit(0).alias("fm"), F.lit(None).cast("string").alias("title"))
    name = F.regexp_replace(F.regexp_replace(note_id, r"^.*/", ""), r"\.md$", "")
    return F.coalesce(F.aggregate(F.slice(lines(content), 1, 25), start, step)["title"], name)


def frontmatter_int(content: Column, field: str) -> Column:
    """First parsable whole number of ``field`` between the first two ``---`` of the first 30 lines; 0 if there is none."""
    def step(acc: Column, line: Column) -> Column:
        value = trim_control(F.substr(line, F.lit(len(field) + 2)))
        found = acc["value"].isNull() & (acc["fm"] == 1) & F.startswith(line, F.lit(f"{field}:")) & F.regexp_like(value, F.lit(r"^[+-]?[0-9]{1,9}$"))
        return F.struct((acc["fm"] + (line == "---").cast("int")).alias("fm"), F.when(found, value.cast("int")).otherwise(acc["value"]).alias("value"))

    start = F.struct(F.lit(0).alias("fm"), F.lit(None).cast("int").alias("value"))
    return F.coalesce(F.aggregate(F.slice(lines(content), 1, 30), start, step)["value"], F.lit(0))


def tags(content: Column) -> Column:
    """Distinct lower-cased ``#tag`` names, sorted; not after a word character or slash."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(content), F.lit(r"(?<![\w/])#([a-zA-Z][a-zA-Z0-9_-]*)"), F.lit(1)), F.lower)))


def without_code(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(content), _FENCED, " "), _INLINE, " ")


_LINK = r"\[\[([^\]\|\n]+)(?:\|([^\]\n]*))?\]\]"


def link_refs(content: Column) -> Column:
    """``struct(target, type)`` of every ``[[target|type]]`` outside code, in order; the type is null when absent or equal to the target."""
    clean = without_code(content)
    pages = F.transform(F.regexp_extract_all(clean, F.lit(_LINK), F.lit(1)), trim_control)
    kinds = F.transform(F.regexp_extract_all(clean, F.lit(_LINK), F.lit(2)), trim_control)
    both = F.filter(F.arrays_zip(pages.alias("p"), kinds.alias("k")), lambda x: x["p"] != "")
    return F.transform(both, lambda x: F.struct(normalize_id(x["p"]).alias("target"), F.when((x["k"] != "") & (x["k"] != x["p"]), F.regexp_replace(F.lower(x["k"]), "[^a-z0-9_]", "_")).alias("type")))


def links(content: Column) -> Column:
    """Distinct normalised link targets, sorted."""
    return F.array_sort(F.array_distinct(F.transform(link_refs(content), lambda x: x["target"])))


def link_types(content: Column) -> Column:
    """Map of target to type; the last one given for a target holds."""
    typed = F.filter(link_refs(content), lambda x: x["type"].isNotNull())
    targets = F.array_distinct(F.transform(typed, lambda x: x["target"]))
    return F.map_from_entries(F.transform(targets, lambda t: F.struct(t, F.element_at(F.filter(typed, lambda x: x["target"] == t), -1)["type"])))


def headings(content: Column) -> Column:
    """Distinct ATX headings outside fenced code and front matter, sorted."""
    body = F.regexp_replace(F.regexp_replace(text(content), r"(?s)\A---\r?\n.*?\n---\r?(?=\n|\z)", ""), _FENCED, " ")
    found = F.regexp_extract_all(body, F.lit(r"(?m)^ {0,3}#{1,6}[ \t]+([^\r\n]*?)[ \t]*#*[ \t]*\r?$"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, trim_control), lambda x: x != "")))


def plain_words(content: Column) -> Column:
    """Lower-cased ASCII words of at least three letters after code and Markdown characters are gone, stop words dropped, repeats kept."""
    t = without_code(content)
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[\[([^\]|]*)(?:\|[^\]]*)?\]\]", "$1")
    t = F.lower(F.regexp_replace(t, r"[#*_~>|\[\](){}]", " "))
    return F.filter(F.regexp_extract_all(t, F.lit("([a-zA-Z]{3,})"), F.lit(1)), lambda w: ~w.isin(*KEYWORD_STOP_WORDS))


def body(content: Column) -> Column:
    """Content without front matter, without the first ``# `` heading, and without lines of tags alone above it, stripped."""
    unix = F.regexp_replace(text(content), r"\r\n|\r", "\n")
    plain = F.regexp_replace(unix, r"(?s)\A---\n(?:.*?\n)??(?:---|\.\.\.)(?:\n|\z)", "")

    def around(padded: Column) -> Column:
        at = F.instr(padded, "\n# ")
        above = F.when(at == 0, padded).otherwise(F.substr(padded, F.lit(1), at))
        below = F.when(at == 0, F.lit("")).otherwise(F.regexp_replace(F.substr(padded, at + 1), r"\A[^\n]*(?:\n|\z)", ""))
        return F.concat(F.regexp_replace(above, r"(?m)^(?:#[a-zA-Z][a-zA-Z0-9_-]*[ \t\x0B\f]*)+(?:\n|\z)", ""), below)

    return F.regexp_replace(let(F.concat(F.lit("\n"), plain), around), r"\A\s+|\s+\z", "")


def paragraphs(content: Column, least: int = LEAST_PARAGRAPH) -> Column:
    """Blocks between blank lines, trimmed, at least ``least`` characters long."""
    return F.filter(F.transform(F.split(text(content), r"\n\s*\n"), trim_control), lambda x: F.length(x) >= least)


def section(content: Column, heading: str) -> Column:
    """The section under a heading (case ignored) with its deeper sub-headings, trimmed; null if there is no such heading."""
    name = heading.strip().lower()

    def head(line: Column) -> Column:
        """Level of a heading line, negative if it is the one asked for; 0 for other lines."""
        def of(t: Column) -> Column:
            level = F.length(F.regexp_extract(t, "^(#+)", 1))
            return F.when(F.lower(trim_control(F.regexp_replace(t, "^#+", ""))) == name, -level).otherwise(level)

        return let(trim_control(line), lambda t: F.when(F.startswith(t, F.lit("#")), of(t)).otherwise(F.lit(0)))

    def step(acc: Column, level: Column) -> Column:
        begins = (acc["first"] == 0) & (level < 0)
        ends = (acc["first"] > 0) & (acc["last"] == 0) & (level != 0) & (F.abs(level) <= acc["level"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(begins, acc["i"] + 1).otherwise(acc["first"]).alias("first"), F.when(begins, -level).otherwise(acc["level"]).alias("level"), F.when(ends, acc["i"]).otherwise(acc["last"]).alias("last"))

    def cut_out(all_lines: Column) -> Column:
        zero = F.lit(0)
        span = F.aggregate(F.transform(all_lines, head), F.struct(zero.alias("i"), zero.alias("first"), zero.alias("level"), zero.alias("last")), step)
        last = lambda x: F.when(x["last"] == 0, x["i"]).otherwise(x["last"])
        return let(span, lambda x: F.when(x["first"] > 0, trim_control(F.array_join(F.slice(all_lines, x["first"], last(x) - x["first"] + 1), "\n"))))

    return let(lines(content), cut_out)


def summary_line(note_body: Column) -> Column:
    """First stripped line that is not empty and starts neither with ``#`` nor a code fence; empty if there is none."""
    stripped = F.transform(lines(note_body), trim_control)
    return F.coalesce(F.get(F.filter(stripped, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("```"))), F.lit(0)), F.lit(""))


def search_body(note_type: Column, note_body: Column) -> Column:
    """The body with its type and summary line in front."""
    line = summary_line(note_body)
    head = F.concat(F.lit("> **["), F.upper(note_type), F.lit("]**"), F.when(line != "", F.concat(F.lit(" "), line)).otherwise(F.lit("")), F.lit("\n\n"))
    return F.concat(head, text(note_body))


def embed_text(note_title: Column, content: Column) -> Column:
    """What is embedded of a note: its title and the first 512 characters, at most 2048 together."""
    return F.substring(F.concat(trim_control(text(note_title)), F.lit(" "), F.substring(text(content), 1, 512)), 1, 2048)


def strip_stop_words(content: Column, words: list[str] = FILTER_STOP_WORDS) -> Column:
    """Stop words removed, runs of blanks folded, trimmed."""
    # word characters are the ASCII ones, whatever the Java version takes a word boundary for
    out = F.regexp_replace(text(content), r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])", "")
    return trim_control(F.regexp_replace(out, r"[ \t]{2,}", " "))


def set_frontmatter(content: Column, field: str, value: Column) -> Column:
    """Content with ``field: value`` in its front matter: replaced, appended, or in a new block in front."""
    content = text(content)
    line = F.concat(F.lit(f"{field}: "), value.cast("string"))
    end = F.locate("\n---", content, 4)
    has = (F.startswith(content, F.lit("---\n")) | F.startswith(content, F.lit("---\r\n"))) & (end > 0)
    front, rest = F.substr(content, F.lit(1), end - 1), F.substr(content, end)
    changed = F.when(F.contains(front, F.lit(f"\n{field}:")), F.regexp_replace(front, F.lit(f"(?m)^{field}:.*$"), line)).otherwise(F.concat(front, F.lit("\n"), line))
    return F.when(has, F.concat(changed, rest)).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), content))


def render_note(note_title: Column, note_body: Column, note_tags: Column, note_links: Column, fields: dict[str, Column] | None = None) -> Column:
    """A note as Markdown: front matter of the fields that have a value, heading, tag line, body, related links."""
    fields = fields or {}
    entries = F.filter(F.array(*[F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]).cast("array<string>"), lambda x: x.isNotNull())
    front = F.when(F.size(entries) > 0, F.concat(F.lit("---\n"), F.array_join(entries, "\n"), F.lit("\n---\n"))).otherwise(F.lit(""))
    tag_line = F.when(F.coalesce(F.size(note_tags), F.lit(0)) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(note_tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(F.lower(trim_control(t)), "[^a-z0-9_-]", "-"))), " "))).otherwise(F.lit(""))
    stripped = trim_control(text(note_body))
    body_part = F.when(stripped != "", F.concat(F.lit("\n\n"), stripped)).otherwise(F.lit(""))
    related = F.when(F.coalesce(F.size(note_links), F.lit(0)) > 0, F.concat(F.lit("\n\n## Related\n\n"), F.array_join(F.transform(note_links, lambda x: F.concat(F.lit("- [["), F.regexp_replace(x, r"\.md$", ""), F.lit("]]"))), "\n"))).otherwise(F.lit(""))
    return F.concat(front, F.lit("# "), F.coalesce(trim_control(note_title), F.lit("Untitled")), tag_line, body_part, related, F.lit("\n"))


def size_bucket(n: Column) -> Column:
    """Power-of-two bucket of a size as text: ``0`` or ``lower-upper``."""
    low = F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long")
    return F.when(n <= 0, F.lit("0")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low * 2).cast("string")))


def content_signature(content: Column, kind: str) -> Column:
    """First 24 hex digits of the SHA-256 of a text's shape: a label of its kind, size buckets and flags, no content."""
    content = text(content)
    words = F.filter(F.split(content, r"\s+"), lambda x: x != "")
    line_count = F.when(content == "", F.lit(0)).otherwise(F.length(content) - F.length(F.replace(content, F.lit("\n"))) + 1)
    filled = F.filter(F.split(content, r"\r\n|[\n\r]"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    average = F.when(F.size(filled) > 0, F.floor(F.aggregate(filled, F.lit(0), lambda a, x: a + F.length(x)) / F.size(filled))).otherwise(F.lit(0))

    def flag(c: Column) -> Column:
        return F.when(c, F.lit("1")).otherwise(F.lit("0"))

    shape = F.concat_ws(
        "|", F.lit(kind), F.concat(F.lit("chars:"), size_bucket(F.length(content))), F.concat(F.lit("words:"), size_bucket(F.size(words))), F.concat(F.lit("lines:"), size_bucket(line_count)),
        F.concat(F.lit("avg_line:"), size_bucket(average)), F.concat(F.lit("paths:"), flag(F.regexp_like(content, F.lit(r"[/\\]")))), F.concat(F.lit("assign:"), flag(F.exists(F.slice(words, 1, 200), lambda w: F.contains(w, F.lit("="))))),
        F.concat(F.lit("brackets:"), flag(F.regexp_like(content, F.lit(r"[{}\[\]()]")))), F.concat(F.lit("errors:"), flag(F.regexp_like(F.lower(content), F.lit("error|exception|traceback|failed|fatal")))))
    return F.substring(F.sha2(shape, 256), 1, 24)


def reflection_intent(prompt: Column) -> Column:
    """Whether a prompt asks for reflection."""
    return F.regexp_like(F.lower(text(prompt)), F.lit("|".join(REFLECTION_PHRASES)))
