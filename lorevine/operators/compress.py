"""Text compression by keeping the words that a scorer finds worth keeping.

A text is split at white space into words, and those into windows of ``WINDOW``; words are kept by threshold or as the best share of each window, joined by single
blanks. Scorers are Columns over the words; ``length_score`` is a deterministic one, ``with_model`` takes any function over batches of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorevine.functions.markdown import let, text

WINDOW = 350
LEAST_WORDS = 10
LEAST_CHARS = 300
THRESHOLD = 0.5
#: A message is replaced only if less than this share of it is left; a marker is added below the second.
KEEP_BELOW, MARK_BELOW = 0.9, 0.8
ROLES = ("tool", "assistant")


def split_words(content: Column) -> Column:
    return F.filter(F.split(text(content), r"\s+"), lambda w: w != "")


def length_score(word: Column) -> Column:
    """A word's letters and digits over twelve, at most 1: a stand-in for a model."""
    return F.least(F.lit(1.0), F.length(F.regexp_replace(word, "[^A-Za-z0-9]", "")) / F.lit(12.0))


def compress_threshold(content: Column, score: Callable[[Column], Column] = length_score, threshold: float = THRESHOLD) -> Column:
    """Words scoring above ``threshold``; texts of fewer than ten words, and those that nothing is left of, stay as they are."""
    def shorten(words: Column) -> Column:
        kept = F.filter(words, lambda w: score(w) > threshold)
        return let(kept, lambda k: F.when((F.size(words) < LEAST_WORDS) | (F.size(k) == 0), text(content)).otherwise(F.array_join(k, " ")))

    return let(split_words(content), shorten)


def compress_long(content: Column, compress: Callable[[Column], Column] = compress_threshold) -> Column:
    """Texts of at least ``LEAST_CHARS`` characters compressed; shorter ones, and null, as they are."""
    return F.when(F.length(content) >= LEAST_CHARS, compress(content)).otherwise(content)


def compress_share(content: Column, ratio: float, score: Callable[[Column], Column] = length_score) -> Column:
    """Of each window the ``max(1, floor(n * ratio))`` best words (ties by position) in their order; short texts stay as they are."""
    def window(words: Column, at: Column) -> Column:
        part = F.transform(F.slice(words, at, WINDOW), lambda w, i: F.struct((-score(w)).alias("s"), i.alias("i"), w.alias("w")))
        best = let(part, lambda p: F.slice(F.array_sort(p), 1, F.greatest(F.lit(1), F.floor(F.size(p) * ratio)).cast("int")))
        return F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])

    def shorten(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words), F.lit(WINDOW))
        return F.when(F.size(words) < LEAST_WORDS, text(content)).otherwise(F.array_join(F.flatten(F.transform(starts, lambda at: window(words, at))), " "))

    return let(split_words(content), shorten)


def savings(original: Column, compressed: Column) -> dict[str, Column]:
    """Word counts, words saved, share saved in percent, and ratio."""
    o, c = F.size(split_words(original)), F.size(split_words(compressed))
    saved = F.greatest(F.lit(0), o - c)
    return {"original_tokens": o, "compressed_tokens": c, "tokens_saved": saved, "savings_percentage": F.when(o > 0, saved / o * 100.0).otherwise(F.lit(0.0)), "compression_ratio": F.when(o > 0, c / o).otherwise(F.lit(1.0))}


def marked(original: Column, compressed: Column) -> Column:
    """``compressed`` with a marker by which the original can be fetched, where less than 0.8 of it is left."""
    o, c = F.size(split_words(original)), F.size(split_words(compressed))
    key = F.substring(F.sha2(text(original), 256), 1, 24)
    note = F.concat(F.lit("\n["), o.cast("string"), F.lit(" items compressed to "), c.cast("string"), F.lit(". Retrieve more: hash="), key, F.lit("]"))
    return F.when((o > 0) & (c / o < MARK_BELOW), F.concat(compressed, note)).otherwise(compressed)


def word_max(tokens: DataFrame, chunk: list[str]) -> DataFrame:
    """``(chunk..., word_id, score)``: of ``tokens(chunk..., word_id, score)`` the best score of each word's tokens; tokens of no word (null) are left out."""
    return tokens.where(F.col("word_id").isNotNull()).groupBy(*chunk, "word_id").agg(F.max("score").alias("score"))


def routed(content: Column, kind: Column, compressors: dict[str, Callable[[Column], Column]], fallback: Callable[[Column], Column] = compress_threshold) -> tuple[Column, Column]:
    """``(compressed, skipped)``: each text by the compressor of its kind, others by ``fallback``; texts below ``LEAST_CHARS``, and results that are no shorter, are passed on as they are and marked skipped."""
    way = fallback(content)
    for name, compressor in compressors.items():
        way = F.when(kind == name, compressor(content)).otherwise(way)
    skipped = F.coalesce((F.length(content) < LEAST_CHARS) | (F.length(way) >= F.length(content)), F.lit(True))
    return F.when(skipped, content).otherwise(way), skipped


def originals(df: DataFrame, content: str) -> DataFrame:
    """``(hash, original)``: the side table that markers point to."""
    return df.where(F.col(content).isNotNull()).select(F.substring(F.sha2(content, 256), 1, 24).alias("hash"), F.col(content).alias("original")).distinct()


def compress_messages(role: Column, content: Column) -> Column:
    """Messages of tools and the assistant with at least ten words compressed where less than 0.9 is left; others unchanged."""
    new = compress_threshold(content)
    words = F.size(split_words(content))
    better = role.isin(*ROLES) & (words >= LEAST_WORDS) & (F.size(split_words(new)) / words < KEEP_BELOW)
    return F.when(better, new).otherwise(content)


def with_model(df: DataFrame, key: str, content: str, score: Callable[[list[str]], list[float]], threshold: float = THRESHOLD) -> DataFrame:
    """``(key, compressed)`` by any batch scorer, loaded once for each Python worker; a failure leaves the text as it is."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["_text"]:
                words = (t or "").split()
                if len(words) < LEAST_WORDS:
                    out.append(t)
                    continue
                try:
                    kept = [w for at in range(0, len(words), WINDOW) for w, s in zip(words[at:at + WINDOW], score(words[at:at + WINDOW]), strict=True) if s > threshold]
                except Exception:  # a model that fails must not lose the text
                    kept = words
                out.append(" ".join(kept) or t)
            yield pd.DataFrame({"key": batch["key"], "compressed": out})

    return df.select(F.col(key).alias("key"), F.col(content).alias("_text")).mapInPandas(run, f"key {kind}, compressed string")
