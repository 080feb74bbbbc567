"""Filling fixed-capacity containers with items: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Items are cut only where one is larger than a container: into full containers and a remainder. Pieces are dealt to groups by a hash of their identity, so groups are alike in size and
mix whatever order or skew the input has; each group is packed by itself. The expected group size is ``GROUP``, so the unused space of a
group's last bins (about one container a group) vanishes in it, and no task holds more than a group.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces expected in a group.
GROUP = 4096
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once for each Python worker."""
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


#: Characters that are given to the tokenizer at once; longer texts are cut before a blank line or blank, where no token spans.
CHUNK = 100_000


def token_count(text: str, path: str) -> int:
    """Tokens of a text; a text of any length is processed whole."""
    enc = encoder(path)
    total, at = 0, 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + 1, at + CHUNK)
        while cut > at and text[cut - 1].isspace():
            cut -= 1
        if cut <= at:
            cut = at + CHUNK
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def sized(documents: DataFrame, key: str, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``(key, n_tokens)`` of every row with a key; null texts have none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "n_tokens": [token_count(t, tokenizer) if isinstance(t, str) else 0 for t in batch["_text"]]})

    kind = documents.schema[key].dataType.simpleString()
    return documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInPandas(run, f"key {kind}, n_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number for each of ``sizes`` (descending): the lowest bin with room.

    A tournament tree holds the largest room below each node; a descent finds the leftmost bin that fits in logarithmic time.
    """
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        room[node] -= size
        node //= 2
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def packed(items: DataFrame, capacity: int, group_size: int = GROUP) -> DataFrame:
    """``(key, copy, piece, n_tokens, bin_group, bin)`` for ``items(key, n_tokens)``: a container is named by ``(bin_group, bin)``.

    Items without tokens (and null or negative sizes) need no container and are left out; repeated rows are copies, each packed.
    Ties in size are packed by key, so the result is the same on every run. The capacity must be positive.
    """
    if capacity <= 0:
        raise ValueError("the capacity must be positive")
    kind = items.schema["key"].dataType.simpleString()
    counted = items.where(F.col("n_tokens") > 0).groupBy("key", "n_tokens").agg(F.count("*").alias("copies"))
    pieces = counted.select("key", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    whole = F.floor((F.col("n_tokens") - 1) / F.lit(capacity))
    pieces = pieces.select("key", "copy", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece"), F.col("n_tokens").alias("all"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece") * capacity))
    total = items.where(F.col("n_tokens") > 0).agg(F.sum(F.floor((F.col("n_tokens") - 1) / F.lit(capacity)) + 1)).first()[0] or 0
    groups = max(1, -(-int(total) // group_size))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("key", "copy", "piece", F.lit(17)), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "copy", "piece"], ascending=[False, True, True, True])
        return pdf.assign(bin=np.array(first_fit_decreasing(pdf["n_tokens"].tolist(), capacity), dtype=np.int64))

    return dealt.select("key", "copy", "piece", "n_tokens", "bin_group").groupBy("bin_group").applyInPandas(pack, f"key {kind}, copy long, piece long, n_tokens long, bin_group long, bin long")
