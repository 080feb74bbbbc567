"""Exact set-similarity joins by pigeonhole partitioning with one-deletion signatures.

A set is a sparse 0/1 vector over its token universe. Two sets with Jaccard similarity ``>= t`` differ in at most
``H = floor((|r| + |s|) * (1 - t) / (1 + t))`` places. The universe is split by hash into segments whose number depends on the length class of the
smaller set. The larger set (the probe) spends a budget of ``H + 1`` over the segments: 1 to test a segment for equality, 2 to test it for at most one
differing place. If every test failed, the sets would differ in at least ``H + 1`` places; so some test succeeds for every
similar pair, and joining on equal signatures loses none. A segment with one place made a wildcard is the segment with that token deleted, so "differs
in at most one place" means: full = full, full = deletion, or deletion = full.

Most signatures are of one set only. Before any is joined, a sketch tells which can meet another at all (``_screened``): sets lie in chunks, a chunk sends the sorted hashes of its signatures to the
parts of the hash range, as compressed differences of two to three bytes each, and gets one bit for each back. Only signatures that an index set and a probe set of two different records have are joined
as rows. A signature that very many sets have is sent once for each chunk, so no part depends on it, and hashes that collide only keep a few rows more.

Which segments get the budget is chosen per probe set by expected cost, from token frequencies counted over all sets in a fixed number of
buckets (``FREQUENCY_BUCKETS``, so the table sent to the executors has a bounded size). Frequencies steer cost only, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.runtime import cut

#: Buckets of the token frequency table.
FREQUENCY_BUCKETS = 1 << 19
#: Sets up to this size have a length class each; above, classes grow by ``GROWTH``.
EXACT_CLASSES, GROWTH = 12, 1.3
#: Expected tokens of a set in one segment.
PER_SEGMENT = 2.5


def class_bounds(limit: int) -> np.ndarray:
    """Largest size of each length class, up to the first that is at least ``limit``."""
    bounds = list(range(1, EXACT_CLASSES + 1))
    while bounds[-1] < limit:
        bounds.append(int(bounds[-1] * GROWTH) + 1)
    return np.array(bounds, dtype=np.int64)


def segment_count(top: int, t: float) -> int:
    """Segments for sets of a class whose largest size is ``top``: enough to spend the largest budget."""
    most = math.floor((top + top / t) * (1 - t) / (1 + t) + 1e-9)
    return max((most + 2) // 2, math.ceil(top / PER_SEGMENT)) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of splitmix; numbers wrap."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ordered(values: np.ndarray, shift: int = 32) -> np.ndarray:
    """Numbers that are not negative as the upper (whole ones) or lower part of a sort key: one sort of 64-bit keys is several times as fast as one by columns."""
    bits = values.astype(np.float32).view(np.uint32) if values.dtype.kind == "f" else values
    return bits.astype(np.uint64) << np.uint64(shift)


class _Batch:
    """Flattened sets of one Arrow batch: tokens with the row they belong to."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        lists = batch.column("tokens")
        self.sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.rows = np.repeat(np.arange(len(self.ids)), self.sizes)

    def segments(self, rows: np.ndarray, keep: np.ndarray, counts: np.ndarray, salt: np.ndarray):
        """Of the tokens at ``keep``: global segment numbers, token hashes, start of each row's segments, and the full signature of each segment."""
        tokens, of = self.tokens[keep], rows
        starts = np.concatenate([[0], np.cumsum(counts)])
        local = (_mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)) % counts[of].astype(np.uint64)).astype(np.int64)
        segment = starts[of] + local
        hashed = _mix(tokens)
        full = np.zeros(starts[-1], dtype=np.uint64)
        np.add.at(full, segment, hashed)
        which = np.arange(starts[-1]) - np.repeat(starts[:-1], counts)
        mark = _mix((np.repeat(salt, counts).astype(np.uint64) << np.uint64(32)) + which.astype(np.uint64))
        return segment, hashed, starts, full, mark


def _keys(value: np.ndarray, mark: np.ndarray, deletion: bool) -> np.ndarray:
    return _mix(value * np.uint64(2) + np.uint64(deletion) + mark).view(np.int64)


#: Sets that are worked on at once; bounds a worker's memory whatever the batch size.
SLICE = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            b = _Batch(batch.slice(at, SLICE))
            if len(b.tokens):
                yield b


_SCHEMA = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int32())])


def _emit(key, ids, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids.astype(np.int64)), pa.array(sizes.astype(np.int32))], schema=_SCHEMA)


def _index(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for b in _slices(batches):
            bounds = class_bounds(int(b.sizes.max()))
            cls = np.searchsorted(bounds, b.sizes)
            counts = np.array([segment_count(int(x), t) for x in bounds])[cls]
            segment, hashed, starts, full, mark = b.segments(b.rows, slice(None), counts, cls)
            owner = np.repeat(np.arange(len(b.ids)), counts)
            yield _emit(_keys(full, mark, False), b.ids[owner], b.sizes[owner])
            yield _emit(_keys(full[segment] - hashed, mark[segment], True), b.ids[b.rows], b.sizes[b.rows])
    return run


def _probe(t: float, frequency, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen = frequency.value
        for b in _slices(batches):
            bounds = class_bounds(int(b.sizes.max()))
            share = np.minimum(1.0, seen[(b.tokens % np.uint64(len(seen))).astype(np.int64)] / max(total, 1))
            cls = np.searchsorted(bounds, b.sizes)
            low = np.searchsorted(bounds, np.ceil(b.sizes * t - 1e-9).astype(np.int64))
            for back in range(int((cls - low).max()) + 1):
                here = (cls - back >= low) & (b.sizes > 0)
                if not here.any():
                    continue
                at = np.flatnonzero(here)
                new = np.full(len(b.ids), -1)
                new[at] = np.arange(len(at))
                keep = here[b.rows]
                rows = new[b.rows[keep]]
                c = cls[at] - back
                counts = np.array([segment_count(int(x), t) for x in bounds])[c]
                segment, hashed, starts, full, mark = b.segments(rows, keep, counts, c)
                n = len(full)
                part = share[keep]
                # expected size of a signature's posting: the rarest token's share, damped by the shares of the others
                k = np.bincount(segment, minlength=n)
                logs = np.log(np.maximum(part, 1.0 / max(total, 1)))
                half = np.bincount(segment, weights=logs / 2, minlength=n)
                least = np.zeros(n)
                np.minimum.at(least, segment, logs)
                cost = total * np.exp(half + least / 2)
                order = np.argsort(_ordered(segment) + (np.uint64(0xFFFFFFFF) - _ordered(np.abs(logs), 0)))
                first = np.concatenate([[True], segment[order][1:] != segment[order][:-1]])
                second = np.zeros(n)  # rarest but one, for the deletion of the rarest
                pos = np.flatnonzero(first) + 1
                ok = (pos < len(order)) & ~np.append(first, True)[np.minimum(pos, len(order))]
                second[segment[order][pos[ok]]] = logs[order][pos[ok]]
                is_first = np.zeros(len(segment), bool)
                is_first[order[first]] = True
                left = np.where(is_first, second[segment], least[segment])
                gone = np.bincount(segment, weights=total * np.exp(half[segment] - logs / 2 + left / 2), minlength=n)
                more = gone + cost  # as a deletion of a longer segment
                owner = np.repeat(np.arange(len(at)), counts)
                size = b.sizes[at]
                high = np.floor((size + np.minimum(bounds[c], size)) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)
                price = np.concatenate([cost, np.maximum(more, cost)])
                unit = np.concatenate([np.arange(n), np.arange(n)])
                stage = np.repeat(np.array([0, 1], dtype=np.uint64), n)
                sort = np.argsort(_ordered(owner[unit], 33) + _ordered(price, 1) + stage, kind="stable")
                base = np.concatenate([[0], np.cumsum(2 * counts)])[:-1]
                rank = np.arange(2 * n) - base[owner[unit[sort]]]
                chosen = sort[rank <= high[owner[unit[sort]]]]
                level = np.bincount(unit[chosen], minlength=n)
                eq, one = level >= 1, level >= 2
                ids = b.ids[at]
                yield _emit(_keys(full[eq], mark[eq], False), ids[owner[eq]], size[owner[eq]])
                yield _emit(_keys(full[one], mark[one], True), ids[owner[one]], size[owner[one]])
                d = one[segment]
                yield _emit(_keys((full[segment] - hashed)[d], mark[segment[d]], False), ids[rows[d]], size[rows[d]])
    return run


#: Buckets in one row of the packed table.
BLOCK = 1 << 13


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            tokens = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            total += np.bincount((tokens % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        used = [i for i in range(buckets // BLOCK) if total[i * BLOCK:(i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i * BLOCK:(i + 1) * BLOCK].tobytes() for i in used], pa.binary())], names=["block", "counts"])
    return run


def _sum(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist()], axis=0)
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.astype(np.int64).tobytes()], pa.binary())})


def frequency_blocks(sets: DataFrame, buckets: int = FREQUENCY_BUCKETS) -> DataFrame:
    """``(block, counts)``: occurrences of tokens by bucket over all sets, packed; at most ``buckets / BLOCK`` rows."""
    return sets.select("tokens").mapInArrow(_count(buckets), "block int, counts binary").groupBy("block").applyInArrow(_sum, "block int, counts binary")


def frequency_table(blocks: DataFrame, buckets: int = FREQUENCY_BUCKETS) -> np.ndarray:
    """The packed table on the driver: ``buckets`` numbers, whatever the data."""
    out = np.zeros(buckets, dtype=np.float32)
    for row in blocks.collect():
        out[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.counts, dtype=np.int64)
    return out


#: Tokens that a chunk of sets is meant to hold, and signatures expected of a token; signatures that a part of the hash range is meant to hold.
CHUNK_TOKENS, PER_TOKEN, PART_SIGNATURES = 400_000, 4, 4_000_000


@dataclass(frozen=True)
class _Plan:
    """How signatures are made and screened: similarity, broadcast frequencies, number of sets, bits of a screened hash, parts of their range."""

    t: float
    frequency: object
    total: int
    bits: int
    parts: int

    def signatures(self, chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, ids, sizes and sides (1 index, 2 probe) of all signatures of a chunk."""
        batches = chunk.select(["id", "tokens"]).sort_by("id").combine_chunks().to_batches()  # in one order, so that the same are made each time
        out = [(b, side) for side, make in ((1, _index(self.t)), (2, _probe(self.t, self.frequency, self.total))) for b in make(iter(batches))]
        if not out:
            return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int32, np.int8))
        key, ids, size = (np.concatenate([b.column(k).to_numpy() for b, _ in out]) for k in range(3))
        return key, ids, size, np.repeat(np.array([side for _, side in out], dtype=np.int8), [b.num_rows for b, _ in out])

    def hashed(self, key: np.ndarray) -> np.ndarray:
        return key.view(np.uint64) >> np.uint64(64 - self.bits)

    def cuts(self, hashes: np.ndarray) -> np.ndarray:
        """Where the parts of the hash range begin in sorted ``hashes``."""
        return np.searchsorted(hashes, np.array([(p << self.bits) // self.parts for p in range(self.parts + 1)], dtype=np.uint64))


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte, compressed."""
    return pa.compress(np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * count, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, count).T).view(np.uint64).ravel(), dtype=np.uint64)


def _bits(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=count).astype(bool)


def _sketched(plan: _Plan):
    """Of a chunk: its distinct signature hashes by part, and for each whether an index set, a probe set, and more than one record has it."""
    def run(chunk: pa.Table) -> pa.Table:
        key, ids, _, side = plan.signatures(chunk)
        h = plan.hashed(key)
        order = np.argsort(h)
        h, ids, side = h[order], ids[order], side[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        hashes = h[first]
        flags = [np.zeros(0, bool)] * 3
        if len(first):
            sides = np.bitwise_or.reduceat(side, first)
            flags = [sides & 1 > 0, sides & 2 > 0, np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)]
        at = plan.cuts(hashes)
        used = [p for p in range(plan.parts) if at[p + 1] > at[p]]
        pick = lambda f: pa.array([np.packbits(f[at[p]:at[p + 1]]).tobytes() for p in used], pa.binary())
        name = chunk.column("chunk").slice(0, 1).to_pylist() * len(used)
        return pa.table({"part": pa.array(used, pa.int32()), "chunk": pa.array(name, pa.int64()), "count": pa.array([int(at[p + 1] - at[p]) for p in used], pa.int32()),
                         "hashes": pa.array([_packed(hashes[at[p]:at[p + 1]]) for p in used], pa.binary()), "indexed": pick(flags[0]), "probed": pick(flags[1]), "several": pick(flags[2])})
    return run


_SKETCH = "part int, chunk long, count int, hashes binary, indexed binary, probed binary, several binary"


def _meeting(part: pa.Table) -> pa.Table:
    """Of a part of the hash range: for each chunk one bit a hash, whether an index set and a probe set of different records have it."""
    counts = part.column("count").to_pylist()
    arrays = [_unpacked(h, n) for h, n in zip(part.column("hashes").to_pylist(), counts, strict=True)]
    each = {c: np.concatenate([_bits(x, n) for x, n in zip(part.column(c).to_pylist(), counts, strict=True)]) for c in ("indexed", "probed", "several")}
    h = np.concatenate(arrays)
    order = np.argsort(h)
    sorted_h = h[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
    any_of = {c: np.logical_or.reduceat(v[order], first) for c, v in each.items()}
    good = any_of["indexed"] & any_of["probed"] & (any_of["several"] | (np.diff(np.append(first, len(h))) > 1))
    flags = np.empty(len(h), dtype=bool)
    flags[order] = np.repeat(good, np.diff(np.append(first, len(h))))
    ends = np.cumsum(counts)
    return pa.table({"chunk": part.column("chunk"), "part": part.column("part"), "flags": pa.array([np.packbits(flags[e - n:e]).tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())})


def _kept(plan: _Plan):
    """The signatures of a chunk, made again, that can meet another."""
    def run(chunk: pa.Table, flags: pa.Table) -> pa.Table:
        key, ids, size, side = plan.signatures(chunk) if chunk.num_rows else (np.zeros(0, np.int64),) * 4
        hashes, place = np.unique(plan.hashed(key), return_inverse=True)
        at = plan.cuts(hashes)
        good = np.zeros(len(hashes), dtype=bool)
        for p, raw in zip(flags.column("part").to_pylist(), flags.column("flags").to_pylist(), strict=True):
            good[at[p]:at[p + 1]] = _bits(raw, int(at[p + 1] - at[p]))
        keep = good[place]
        return pa.table({"key": key[keep], "id": ids[keep], "size": size[keep].astype(np.int32), "side": side[keep].astype(np.int8)})
    return run


def _screened(sets: DataFrame, t: float) -> DataFrame:
    """``(key, id, size, side)``: the signatures of ``sets(id, tokens)`` that can meet one of another record; ``side`` 1 is the index, 2 the probe."""
    spark = sets.sparkSession
    total, tokens = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    frequency = spark.sparkContext.broadcast(frequency_table(frequency_blocks(sets)))
    expected = max(1, PER_TOKEN * tokens)
    plan = _Plan(t, frequency, total, min(62, max(32, expected.bit_length() + 8)), max(1, -(-expected // PART_SIGNATURES)))
    dealt = sets.select("id", "tokens", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-tokens // CHUNK_TOKENS)))).alias("chunk"))
    sketch = dealt.groupBy("chunk").applyInArrow(_sketched(plan), _SKETCH)
    flags = sketch.groupBy("part").applyInArrow(_meeting, "chunk long, part int, flags binary")
    return dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_kept(plan), "key long, id long, size int, side byte")


def candidate_pairs(sets: DataFrame, t: float) -> DataFrame:
    """``(p, i)``: candidate pairs of ``sets(id long, tokens array<long>)``, distinct, the probe ``p`` being the larger set (the larger id among equals).

    Contains every pair with Jaccard ``>= t``; tokens of a set must be distinct, ids unique; empty sets have no partners.
    """
    rows = cut(_screened(sets.select("id", "tokens").where(F.size("tokens") > 0), t), "signatures")
    index = rows.where("side = 1").select("key", F.col("id").alias("i"), F.col("size").alias("i_size"))
    probe = rows.where("side = 2").select("key", F.col("id").alias("p"), F.col("size").alias("p_size"))
    fits = (F.col("i_size") >= F.col("p_size") * F.lit(t) - F.lit(1e-9)) & ((F.col("i_size") < F.col("p_size")) | ((F.col("i_size") == F.col("p_size")) & (F.col("i") < F.col("p"))))
    return probe.join(index, "key").where(fits).select("p", "i").distinct()


#: Longs of the parity bitmap of a set.
BITMAP = 8


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set its size and, for each of ``64 * BITMAP`` buckets, whether an odd number of its tokens falls in it."""
    for batch in batches:
        for b in (_Batch(batch.slice(at, SLICE)) for at in range(0, batch.num_rows, SLICE)):
            bucket = (_mix(b.tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * BITMAP)).astype(np.int64)
            odd = np.bincount(b.rows * 64 * BITMAP + bucket, minlength=len(b.ids) * 64 * BITMAP).astype(np.int64) & 1
            words = np.packbits(odd.astype(bool).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(len(b.ids), BITMAP)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids.astype(np.int64)), pa.array(b.sizes.astype(np.int32)), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITMAP)]], names=["id", "n", *[f"w{i}" for i in range(BITMAP)]])


def _close(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """``pairs(p, i)`` without those whose bitmaps differ in more buckets than sets of such sizes can at ``t``: each differing bucket takes a token that only one set has."""
    maps = cut(sets.mapInArrow(_bitmaps, "id long, n int, " + ", ".join(f"w{i} long" for i in range(BITMAP))), "bitmaps")
    named = lambda x: maps.select(*[F.col(c).alias(f"{x}_{c}") for c in maps.columns])
    both = pairs.join(named("p"), F.col("p") == F.col("p_id")).join(named("i"), F.col("i") == F.col("i_id"))
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"p_w{i}").bitwiseXOR(F.col(f"i_w{i}"))) for i in range(BITMAP)])
    return both.where(apart <= (F.col("p_n") + F.col("i_n")) * F.lit((1 - t) / (1 + t)) + F.lit(1e-6)).select("p", "i")


def similar_pairs(sets: DataFrame, t: float) -> DataFrame:
    """``(a, b, shared, jaccard)`` with ``a < b`` for every pair of sets with Jaccard similarity ``>= t``, verified exactly; pairs that bitmaps of their sets rule out are not verified on the tokens."""
    pairs = cut(_close(candidate_pairs(sets, t), sets.select("id", "tokens"), t), "close")
    left = sets.select(F.col("id").alias("p"), F.col("tokens").alias("p_tokens"))
    right = sets.select(F.col("id").alias("i"), F.col("tokens").alias("i_tokens"))
    both = pairs.join(left, "p").join(right, "i").select("p", "i", F.size("p_tokens").alias("np"), F.size("i_tokens").alias("ni"), F.size(F.array_intersect("p_tokens", "i_tokens")).alias("shared"))
    both = both.withColumn("jaccard", F.col("shared") / (F.col("np") + F.col("ni") - F.col("shared")))
    return both.where(F.col("jaccard") >= F.lit(t - 1e-12)).select(F.least("p", "i").alias("a"), F.greatest("p", "i").alias("b"), "shared", "jaccard")
