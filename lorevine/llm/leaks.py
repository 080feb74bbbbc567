"""Evaluation texts leaking into training text, by spaced-seed hashing.

Words become numbers on the JVM's side. Masks over five words ignore one or no position; under every mask each window of an item, and of a document, has a hash. Hashes of documents that a Bloom filter of the items' hashes
lets pass are joined with the items' on equality. Every run of five shared words is a hit under every mask, so none is missed, and a single substituted word still leaves hits on its other side. From the
hits both measures are taken exactly: the share of the item's distinct five-word sequences that occur in the document, and the share of its words that lie in hit windows, where
substituted words inside such windows count.

The documents are read once, whatever the number of items, and only hits are shuffled. The filter has 16 bits for each item hash and at most ``MOST_BITS``; a larger item table makes it less selective and no result
different. If the items' windows are few (counted first, at most ``SENT``), they are sent to the executors and joined there, where all hits of a document lie, and only pairs that reach the measure leave the
task; else hits and windows are joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.functions.words import words
from lorevine.llm.segments import _mix

SPAN = 5
#: Positions of a window that count: all of them, and the masks with a gap.
EXACT, MASKS = (0, 1, 2, 3, 4), ((0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
#: Most bits of the filter, bits of one of its rows, and most item windows that are sent to all executors (about 100 bytes each).
MOST_BITS, BLOCK_BITS, SENT = 1 << 29, 1 << 16, 1_000_000
#: Words of documents that are worked on at once.
SLICE = 500_000


def _numbered(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, w)``: 64-bit numbers of the words of each text."""
    return rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("w"))


def _windows(ids: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Hash of the chosen positions of every window of ``SPAN`` words."""
    n = len(ids) - SPAN + 1
    h = np.full(n, len(at) * 31 + at[1] * 7 + at[-2], dtype=np.uint64)
    for p in at:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[p:p + n])
    return h.view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of together about ``SLICE`` words: row numbers, words, and the row of each window that lies in one row (-1 for others)."""
    lists = batch.column("w")
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
        ids = values[begin:ends[to - 1]]
        if len(ids) >= SPAN:
            owner = np.repeat(np.arange(at, to), sizes[at:to])
            same = owner[:len(ids) - SPAN + 1] == owner[SPAN - 1:]
            yield ids, np.where(same, owner[:len(same)], -1), np.arange(len(same)) - (np.concatenate([[0], ends])[owner[:len(same)]] - begin)
        at = to


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(item, grams, words, start, exact, m0, m1, m2)``: the distinct five-word sequences of each item, at their first place."""
    np.seterr(over="ignore")
    for batch in batches:
        for ids, owner, start in _pieces(batch):
            exact, seeds = _windows(ids, EXACT), [_windows(ids, m) for m in MASKS]
            inside = np.flatnonzero(owner >= 0)
            order = inside[np.lexsort((start[inside], exact[inside], owner[inside]))]
            if not len(order):
                continue
            first = np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (exact[order][1:] != exact[order][:-1])])
            at = order[first]
            grams = np.bincount(owner[at], minlength=batch.num_rows)
            size = np.diff(batch.column("w").offsets.to_numpy())
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), pa.array(grams[owner[at]].astype(np.int32)), pa.array(size[owner[at]].astype(np.int32)), pa.array(start[at].astype(np.int32)), *[pa.array(h[at]) for h in (exact, *seeds)]],
                                             names=["item", "grams", "words", "start", "exact", "m0", "m1", "m2"])


def _filter_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([batch.column(c).to_numpy().view(np.uint64) & np.uint64(size - 1) for c in ("exact", "m0", "m1", "m2")]).astype(np.int64))
            block = at // BLOCK_BITS
            used = np.unique(block)
            bits = []
            for b in used:
                field = np.zeros(BLOCK_BITS, dtype=bool)
                field[at[block == b] % BLOCK_BITS] = True
                bits.append(np.packbits(field, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits, pa.binary())], names=["block", "bits"])
    return run


def _joined(table: pa.Table) -> pa.Table:
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table.column("bits").to_pylist()]).tobytes()], pa.binary())})


def _filter(items: DataFrame, count: int) -> np.ndarray:
    """The Bloom filter of all hashes of the items' windows; at most ``MOST_BITS`` bits come to the driver."""
    size = max(BLOCK_BITS, min(MOST_BITS, 1 << (64 * max(1, count)).bit_length()))
    out = np.zeros(size // 8, dtype=np.uint8)
    blocks = items.select("exact", "m0", "m1", "m2").mapInArrow(_filter_bits(size), "block int, bits binary").groupBy("block").applyInArrow(_joined, "block int, bits binary")
    for row in blocks.collect():
        out[row.block * BLOCK_BITS // 8:(row.block + 1) * BLOCK_BITS // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _hits(shared):
    """``(doc, mask, hash)``: each once for a row, the hashes of its windows that the filter lets pass; mask 3 is the exact one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        field = shared.value
        low = np.uint64(len(field) * 8 - 1)
        for batch in batches:
            for ids, owner, _ in _pieces(batch):
                found = []
                for mask, at in enumerate((*MASKS, EXACT)):
                    h = _windows(ids, at)
                    bit = h.view(np.uint64) & low
                    hit = np.flatnonzero((field[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (owner >= 0))
                    both = np.unique(np.rec.fromarrays([owner[hit], h[hit]], names="o,h")) if len(hit) else np.rec.fromarrays([owner[hit], h[hit]], names="o,h")
                    found.append((both["o"], np.full(len(both), mask, np.int8), both["h"]))
                o, m, h = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(o):
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(o)), pa.array(m), pa.array(h)], names=["doc", "mask", "hash"])
    return run


class _Items:
    """The windows of few items, indexed by each of their hashes."""

    def __init__(self, table: pa.Table):
        names = table.column("item").combine_chunks().dictionary_encode()
        self.names, self.item = names.dictionary, names.indices.to_numpy().astype(np.int64)
        self.start, self.grams, self.words = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "grams", "words"))
        first = np.unique(self.item, return_index=True)[1]
        self.grams, self.words = self.grams[first], self.words[first]
        self.tables = []
        for c in ("m0", "m1", "m2", "exact"):
            h = table.column(c).to_numpy()
            order = np.argsort(h, kind="stable")
            self.tables.append((*np.unique(h[order], return_index=True, return_counts=True), order))

    def hits(self, which: int, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, window)`` of every equal hash, each once."""
        keys, first, count, order = self.tables[which]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        ok = (keys[at] == hashes) & (rows >= 0)
        both = np.unique(rows[ok] * np.int64(len(keys)) + at[ok])
        row, at = both // len(keys), both % len(keys)
        n = count[at]
        return np.repeat(row, n), order[np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _measured(shared, least: float):
    """``(doc, item, shared, tolerant)`` of the pairs of a batch that reach ``least``; all windows of a document lie in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        items = shared.value
        total = len(items.names)
        for batch in batches:
            for ids, owner, _ in _pieces(batch):
                found = [items.hits(i, _windows(ids, m), owner) for i, m in enumerate((*MASKS, EXACT))]
                pairs = np.zeros(0, dtype=np.int64)
                for row, window in found:
                    pair, n = np.unique(row * total + items.item[window], return_counts=True)
                    pairs = np.union1d(pairs, pair[n >= np.ceil(items.grams[pair % total] * least - 1e-9)])
                if not len(pairs):
                    continue
                exact = np.searchsorted(pairs, x := found[3][0] * total + items.item[found[3][1]])
                same = pairs[np.minimum(exact, len(pairs) - 1)] == x
                shares = np.bincount(exact[same], minlength=len(pairs)) / items.grams[pairs % total]
                # words of the item that lie in a hit window, one number for each pair and place
                x = np.concatenate([row * total + items.item[window] for row, window in found[:3]])
                start = np.concatenate([items.start[window] for _, window in found[:3]])
                at = np.minimum(np.searchsorted(pairs, x), len(pairs) - 1)
                keep = pairs[at] == x
                width = items.words.max() + SPAN
                places = np.unique((at[keep][:, None] * width + start[keep][:, None] + np.arange(SPAN)).ravel())
                cover = np.bincount(places // width, minlength=len(pairs)) / items.words[pairs % total]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(pairs // total)), items.names.take(pa.array(pairs % total)), pa.array(shares), pa.array(cover)], names=["doc", "item", "shared", "tolerant"])
    return run


def leaked(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: float = 0.5) -> DataFrame:
    """``(doc, item, shared, tolerant)`` for every document and item where seed hits cover ``least`` of the item's distinct windows under some mask, or exact ones do.

    ``shared`` is the exact share of the item's distinct five-word sequences found in the document, ``tolerant`` the share of its words inside hit windows; all pairs with ``shared >= least`` are contained.
    Null keys and texts, and items of fewer than five words, give no rows; repeated rows of a document or item count once.
    """
    from lorevine.runtime import cut

    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    known = cut(_numbered(items, item_key, item_text).mapInArrow(_item_windows, f"item {item_kind}, grams int, words int, start int, exact long, m0 long, m1 long, m2 long").distinct(), "items")
    count = known.count()
    if not count:
        return documents.sparkSession.createDataFrame([], f"doc {kind}, item {item_kind}, shared double, tolerant double")
    if count <= SENT:
        index = documents.sparkSession.sparkContext.broadcast(_Items(known.toArrow()))
        found = _numbered(documents, key, text).mapInArrow(_measured(index, least), f"doc {kind}, item {item_kind}, shared double, tolerant double")
        return found.groupBy("doc", "item").agg(F.max("shared").alias("shared"), F.max("tolerant").alias("tolerant"))
    field = documents.sparkSession.sparkContext.broadcast(_filter(known, count))
    hits = _numbered(documents, key, text).mapInArrow(_hits(field), f"doc {kind}, mask byte, hash long")
    seeds = F.array(*[F.struct(F.lit(i).cast("byte").alias("mask"), F.col(c).alias("hash")) for i, c in enumerate(("m0", "m1", "m2", "exact"))])
    rows = known.select("item", "grams", "words", "start", F.explode(seeds).alias("x")).select("item", "grams", "words", "start", "x.mask", "x.hash")
    met = hits.join(rows, ["mask", "hash"])
    # one row for each window of the item that is hit in the document, then one for each pair
    window = met.groupBy("doc", "item", "start").agg(F.first("grams").alias("grams"), F.first("words").alias("words"), *[F.max((F.col("mask") == i).cast("int")).alias(f"h{i}") for i in range(4)])
    pair = window.groupBy("doc", "item").agg(F.first("grams").alias("grams"), F.first("words").alias("words"), *[F.sum(f"h{i}").alias(f"n{i}") for i in range(4)], F.sort_array(F.collect_list("start")).alias("at"))
    pair = pair.where(F.greatest("n0", "n1", "n2", "n3") >= F.ceil(F.col("grams") * F.lit(least) - F.lit(1e-9)))
    # words in hit windows: each window adds what reaches beyond the one before
    steps = F.aggregate("at", F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(SPAN), x - acc["last"])).alias("n")), lambda acc: acc["n"])
    return pair.select("doc", "item", (F.col("n3") / F.col("grams")).alias("shared"), (steps / F.col("words")).alias("tolerant"))
