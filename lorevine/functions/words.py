"""Words and word shingles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits of the lower-cased text; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def shingle_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` consecutive words, in order, repeats kept; empty with fewer words."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(tokens, (i + j).cast("int")) for j in range(k)])

    return F.when(F.size(tokens) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(tokens) - k), one))
