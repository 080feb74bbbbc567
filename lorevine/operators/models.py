"""Model boundaries: embedders, the pre-tokeniser and WordPiece, all over Arrow batches.

No model files come with this package. ``hashed_embedding`` is a deterministic stand-in (signed feature hashing) and not equal to any model.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS, MAX_WORD = 2048, 512, 100


def hashed_embedding(text: str, dims: int = 64) -> list[float] | None:
    """Signed feature hashing of a text's words at unit length; None for blank text."""
    import hashlib

    v = np.zeros(dims)
    for word in text[:MAX_CHARS].lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n).tolist() if n > 1e-9 else None


def embed(df: DataFrame, key: str, text: str, model: Callable[[str], list[float] | None] = hashed_embedding) -> DataFrame:
    """``(key, embedding)`` by any function of a text; blank texts and failures give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch["_text"]:
                try:
                    out.append(model(t) if isinstance(t, str) and t.strip() else None)
                except Exception:  # a text that a model fails on has no vector
                    out.append(None)
            yield pd.DataFrame({"key": batch["key"], "embedding": out})

    return df.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInPandas(run, f"key {kind}, embedding array<double>")


def _is_mark(c: str) -> bool:
    return unicodedata.category(c) == "Mn"


def _splits(c: str) -> bool:
    """Whether a character is a token of its own: punctuation, ASCII symbols, CJK ideographs."""
    ascii_symbol = 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126
    return ascii_symbol or unicodedata.category(c).startswith("P") or "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿"


def pretokenize(text: str) -> list[str]:
    """Lower case, decomposed without combining marks, split at blanks, with punctuation and ideographs apart."""
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not _is_mark(c))
    return "".join(f" {c} " if _splits(c) else c for c in folded).split()


def wordpiece(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces of a word, later ones marked ``##``; a word over 100 characters or with an unknown piece is unknown."""
    if len(word) > MAX_WORD:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        end = len(word)
        while end > at and ("##" if at else "") + word[at:end] not in vocabulary:
            end -= 1
        if end == at:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def encode(text: str, vocabulary: dict[str, int], limit: int = MAX_TOKENS) -> list[int]:
    """Ids with the special tokens around, cut to ``limit``."""
    pieces = [p for w in pretokenize(text) for p in wordpiece(w, vocabulary)][:limit - 2]
    return [vocabulary[p] for p in ("[CLS]", *pieces, "[SEP]")]


def encode_pair(query: str, passage: str, vocabulary: dict[str, int], limit: int = MAX_TOKENS) -> tuple[list[int], list[int]]:
    """Ids and segment numbers of a pair: the query takes at most half of the room, the passage the rest."""
    q = [p for w in pretokenize(query) for p in wordpiece(w, vocabulary)][:(limit - 3) // 2]
    p = [x for w in pretokenize(passage) for x in wordpiece(w, vocabulary)][:limit - 3 - len(q)]
    ids = [vocabulary[x] for x in ("[CLS]", *q, "[SEP]", *p, "[SEP]")]
    return ids, [0] * (len(q) + 2) + [1] * (len(p) + 1)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as lines:
        return {line.rstrip("\n"): i for i, line in enumerate(lines)}


def pretokenized(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, tokens)``; null text has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "tokens": [pretokenize(t) if isinstance(t, str) else [] for t in batch["_text"]]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInPandas(run, f"key {kind}, tokens array<string>")
