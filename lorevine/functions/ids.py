"""Note ids and slugs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = "".join(map(chr, range(0x21)))


def trim_control(c: Column) -> Column:
    """Trim every character up to U+0020 at both ends."""
    return F.btrim(c, F.lit(CONTROL))


def normalize_id(raw: Column) -> Column:
    """Normalised note id of a link target.

    Segments between slashes of either kind are trimmed; blank, ``.`` and ``..`` ones are dropped; the others are lower-cased, runs of
    other characters than ``a-z 0-9 . -`` become one ``-``, dashes at the edges go; ``.md`` is appended if missing. Null stays null,
    nothing left gives ``untitled.md``.
    """
    parts = F.filter(F.split(raw, r"[/\\]+"), lambda p: ~trim_control(p).isin("", ".", ".."))

    def clean(p: Column) -> Column:
        p = F.regexp_replace(F.lower(trim_control(p)), r"[^a-z0-9.\-]+", "-")
        return F.regexp_replace(F.regexp_replace(p, r"-+", "-"), r"^-+|-+$", "")

    joined = F.array_join(F.filter(F.transform(parts, clean), lambda p: p != ""), "/")
    named = F.when(joined == "", F.lit("untitled.md")).when(F.endswith(joined, F.lit(".md")), joined).otherwise(F.concat(joined, F.lit(".md")))
    return F.when(raw.isNotNull(), named)


def slugify(text: Column) -> Column:
    """Lower case, other characters than ``a-z0-9`` as single dashes, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def folder_of(note_id: Column) -> Column:
    """Parent path with ``/`` and ``-`` as spaces; null without a parent."""
    return F.when(F.instr(note_id, "/") > 1, F.translate(F.regexp_replace(note_id, r"/[^/]*$", ""), "/-", "  "))
