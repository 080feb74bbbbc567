"""Deduplicating new batches against all history, without reprocessing the history.

The store holds, all below its own path, what earlier batches have left: winnowed fingerprints ``(fp, rec)`` in partitions of the fingerprint range, a Bloom filter for each partition, the shingle sets of accepted
contents for verification, and the links found. A new batch reads its own texts, folds equal contents, winnows, asks the Bloom filters which of its fingerprints can be known at
all, looks only those up, in the partitions that hold any, keeps pairs whose shared fingerprints cover enough, verifies them on the stored shingle sets, and appends to all parts. What
is looked up is sent to the store's scan as long as it is small (counted first, ``SENT`` rows at most), so the store is then not shuffled. Each batch is committed by one manifest; files of a batch that failed
are never referenced, so it is simply run again. After ``MERGE_AT`` batches their parts are merged into one, so the filters asked stay few.

Winnowing takes, of every ``w`` consecutive shingles, the one rarest in a frequency table frozen with the first batch (ties by hash). A window that two records have in common gives both the same fingerprint. How many
windows two records of similarity ``t`` must have in common follows from ``t`` and the words of a shingle ``k`` (``needed``): each place where they differ breaks at least ``k - 1`` shingles on
either side and ``w - 1`` windows more. ``w`` is chosen so that at most half of the shared shingles' windows are broken. Of a record's fingerprints, the most frequent ones are not looked
up as long as they stand for less than half of the windows needed; the others then still have to cover the rest. (The count supposes that shingles which differ are nowhere else in the other record.)
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm.components import components
from lorevine.llm.near_dup import shingled
from lorevine.llm.segments import _mix, frequency_blocks, frequency_table
from lorevine.operators.increments import IncrementStore, Window
from lorevine.runtime import cut

#: Fingerprints that a partition of a batch is meant to hold, and bits of the Bloom filter of a fingerprint, in blocks of 64 bytes; a filter is sent to one task, never to the driver.
PART_SIZE, BITS, HASHES = 1 << 16, 16, 6
#: The most rows that are sent to all executors to be looked up (8 to 40 bytes each).
SENT = 500_000
#: Batches after which the parts of a store are merged.
MERGE_AT = 16


def window_of(t: float, k: int) -> int:
    """Shingles in a winnowing window."""
    return 1 + max(1, math.floor(t * (k - 1) / (1 - t) + 1e-9)) if t < 1 else 64


def needed(n: np.ndarray, t: float, k: int, w: int) -> np.ndarray:
    """Windows that a record of ``n`` shingles must share with one of similarity ``t``, 1 at least."""
    whole = 1 - (w - 1) * (1 - t) / (2 * t * (k - 1)) if k > 1 else 0
    return np.maximum(1, np.floor(t * whole * n - (w - 1) + 1e-9)).astype(np.int64)


def winnow(values: np.ndarray, rank: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, value, windows)``: the distinct values chosen from each row of the flattened ``values`` and the windows each stands for; a row shorter than ``w`` is one window.

    In each window the value of least ``(rank, hash)`` is chosen.
    """
    ends = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    key = (rank.astype(np.uint64) << np.uint64(32)) | (_mix(values.view(np.uint64)) >> np.uint64(32))
    left = (ends[rows] - np.arange(len(values))) if len(values) else np.zeros(0, np.int64)  # values to the end of the row
    short = sizes[rows] < w
    start = np.flatnonzero((left >= w) | (short & (left == sizes[rows])))
    width = np.minimum(w, sizes[rows[start]])
    best, at = key[start].copy(), start.copy()
    for j in range(1, min(w, int(sizes.max()) if len(sizes) else 0)):
        some = np.flatnonzero(width > j)
        k = key[start[some] + j]
        less = k < best[some]
        best[some[less]] = k[less]
        at[some[less]] = start[some[less]] + j
    row, value = rows[at], values[at]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.append(first, len(row)))


#: Columns of winnowed and of stored fingerprints.
_STORED = "fp long, rec long, part int"
_FPS = "fp long, rec long, windows int, need int, ask boolean"


def _winnowing(frequency, t: float, k: int):
    w = window_of(t, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        table = frequency.value
        for batch in batches:
            for piece in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                lists = piece.column("seq")
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                seen = lambda v: np.minimum(table[(v.view(np.uint64) % np.uint64(len(table))).astype(np.int64)], 2**31 - 1).astype(np.int64)  # noqa: E731, B023
                row, fp, count = winnow(values, seen(values), sizes, w)
                need = needed(sizes, t, k, w)[row]
                # the most frequent first; what is passed over stands for less than half of what is needed
                order = np.lexsort((fp, -seen(fp), row))
                over = np.cumsum(count[order])
                begin = np.searchsorted(row[order], np.arange(len(sizes)))
                over -= np.where(begin > 0, over[np.maximum(begin - 1, 0)], 0)[row[order]] if len(over) else 0
                ask = np.ones(len(row), dtype=bool)
                ask[order] = 2 * over >= need[order]
                passed = np.bincount(row[~ask], weights=count[~ask], minlength=len(sizes)).astype(np.int64)
                rec = piece.column("rec").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(rec[row]), pa.array(count.astype(np.int32)), pa.array((need - passed[row]).astype(np.int32)), pa.array(ask)], names=["fp", "rec", "windows", "need", "ask"])
    return run


def _place(fp: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each fingerprint, in the order of its hash, and its ``(n, HASHES)`` bits in the block."""
    h = _mix(fp.view(np.uint64))
    inside = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    return (h >> np.uint64(64 - blocks.bit_length() + 1)).astype(np.int64) if blocks > 1 else np.zeros(len(fp), np.int64), np.stack([(inside >> np.uint64(9 * i)).astype(np.int64) & 511 for i in range(HASHES)], axis=1)


#: Blocks of 512 bits in the filter of one partition.
BLOCKS = PART_SIZE * BITS // 512


def part_of(fp, parts: int):
    """Partition of a fingerprint among ``parts``, a power of two: leading bits of a hash, so that halving the number joins neighbours."""
    return F.shiftrightunsigned(F.xxhash64(fp), 64 - (parts.bit_length() - 1)).cast("int") if parts > 1 else F.lit(0)


def _filter(table: pa.Table) -> pa.Table:
    """The filter of one partition."""
    block, bits = _place(table.column("fp").to_numpy().astype(np.int64), BLOCKS)
    field = np.zeros(BLOCKS * 512, dtype=bool)
    field[(block[:, None] * 512 + bits).ravel()] = True
    return pa.table({"part": table.column("part").slice(0, 1), "parts": table.column("parts").slice(0, 1), "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})


def _asked(fps: pa.Table, filters: pa.Table) -> pa.Table:
    """Of the fingerprints of one partition those that a filter may know or that the batch has more than once."""
    fp = fps.column("fp").to_numpy().astype(np.int64) if fps.num_rows else np.zeros(0, np.int64)
    known = (fps.column("times").to_numpy() > 1) if fps.num_rows else np.zeros(0, bool)
    if len(fp):
        block, bits = _place(fp, BLOCKS)
        at = block[:, None] * 512 + bits
        for raw in filters.column("bits").to_pylist() if filters.num_rows else ():
            field = np.frombuffer(raw, dtype=np.uint8)
            known |= ((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    return pa.table({"fp": pa.array(fp[known])})


def _parts(distinct: DataFrame) -> int:
    """Partitions, a power of two, that hold about ``PART_SIZE`` of the fingerprints each."""
    return 1 << max(0, math.ceil(math.log2(max(1, distinct.count()) / PART_SIZE)))


class HistoryDedup:
    """A persistent duplicate index; ``add`` takes one batch after the other."""

    def __init__(self, spark: SparkSession, path: str, text: list[str], k: int = 5, similarity: float = 0.8, least: int = 0):
        self.spark, self.path, self.text, self.k, self.similarity, self.least = spark, path.rstrip("/"), text, k, similarity, least
        self.store = IncrementStore(spark, self.path)
        self._frequency: tuple[str, object] | None = None

    def _read(self, part: str, schema: str) -> DataFrame:
        folders = self._folders(part)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _folders(self, part: str) -> list[str]:
        """Folders of one part, of the batches that were committed."""
        return [f"{folder}/{part}" for folder in self.store.state()["outputs"]]

    def _frequencies(self, batch: DataFrame, folder: str):
        """The frozen table: that of the first batch that was committed, else one of this batch; at most ``FREQUENCY_BUCKETS`` numbers."""
        schema = "block int, counts binary"
        old = self._folders("frequency")
        if not old:
            return self.spark.sparkContext.broadcast(frequency_table(self._kept(frequency_blocks(batch), f"{folder}/frequency")))
        if self._frequency is None or self._frequency[0] != old[0]:
            self._frequency = old[0], self.spark.sparkContext.broadcast(frequency_table(self.spark.read.schema(schema).parquet(old[0])))
        return self._frequency[1]

    def _only(self, table: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
        """Rows of a stored ``table`` whose ``column`` is in ``wanted``, which goes to the scan if it is small."""
        return table.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, column, "left_semi")

    def add(self, records: DataFrame, key: str, sequence: int) -> None:
        """Check one batch against everything committed and against itself, then commit it under the batch number ``sequence``.

        Keys of a batch must be larger than those before for "earlier" to mean "smaller key". Records that are too short are never
        duplicates. A batch number that is not above the last committed one is refused by the store.
        """
        low = self.store.watermark()
        if low is not None and sequence <= low:
            raise ValueError(f"batch {sequence} does not follow {low}")
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        sets = cut(shingled(records, key, self.text, self.k, self.least).select("rec", "seq", "content"), "shingled")
        frequency = self._frequencies(sets.select(F.col("seq").alias("tokens")), folder)
        known = self._read("sets", "rec long, tokens array<long>, content string")
        # equal contents: the store's representative, else the batch's smallest record
        heads = cut(sets.groupBy("content").agg(F.min("rec").alias("head")), "heads")
        seen = self._only(known.select("content", F.col("rec").alias("old")), heads.select("content"), "content")
        heads = cut(heads.join(seen, "content", "left"), "seen")
        copies = sets.select("rec", "content").distinct().join(heads.select("content", F.coalesce("old", "head").alias("rep")), "content").where("rec <> rep").select(F.col("rec").alias("b"), F.col("rep").alias("a"))
        # what this batch adds is written where it will stay; until the commit nothing refers to it
        new = heads.where("old IS NULL").select(F.col("head").alias("rec"), "content")
        keep = sets.join(new, ["rec", "content"], "left_semi").dropDuplicates(["rec", "content"])
        fresh = self._kept(keep.select("rec", F.sort_array(F.array_distinct("seq")).alias("tokens"), "content"), f"{folder}/sets")
        winnowed = cut(keep.select("rec", "seq").mapInArrow(_winnowing(frequency, self.similarity, self.k), _FPS), "winnowed")
        distinct = cut(winnowed.groupBy("fp").agg(F.count("*").alias("times")), "distinct")
        parts = _parts(distinct)
        self._write_fingerprints(winnowed.select("fp", "rec"), distinct, parts, folder)
        maybe = cut(self._prescreened(distinct, parts), "maybe")
        mine = winnowed.join(maybe, "fp", "left_semi")
        stored = self._only(self._hit_parts(maybe), maybe, "fp")
        there = stored.unionByName(mine.select("fp", "rec")).select("fp", F.col("rec").alias("a"))
        shared = mine.where("ask").select("fp", F.col("rec").alias("b"), "windows", "need").join(there, "fp").where("a < b")
        covered = shared.groupBy("a", "b").agg(F.sum("windows").alias("have"), F.max("need").alias("need")).where("have >= need").select("a", "b")
        covered = cut(covered, "covered")
        # only sets of candidates are read further; the batch's own are known by their keys
        ends = covered.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
        every = cut(self._only(known.select("rec", "tokens").unionByName(fresh.select("rec", "tokens")), ends, "rec"), "candidates")
        both = covered.join(every.select(F.col("rec").alias("a"), F.col("tokens").alias("ta")), "a").join(every.select(F.col("rec").alias("b"), F.col("tokens").alias("tb")), "b")
        same = F.size(F.array_intersect("ta", "tb"))
        near = both.where(same >= F.lit(self.similarity - 1e-12) * (F.size("ta") + F.size("tb") - same)).select("a", "b")
        near.unionByName(copies.select("a", "b")).write.parquet(f"{folder}/links")
        self.store.publish(folder, Window(low, sequence))
        if len(self.store.state()["outputs"]) > MERGE_AT:
            self.merge()

    def _write_fingerprints(self, fps: DataFrame, distinct: DataFrame, parts: int, folder: str) -> None:
        """The fingerprints of a batch in order of their partitions, so that a reader of some partitions skips the others' row groups, and a filter for each partition."""
        fps.withColumn("part", part_of("fp", parts)).repartition("part").sortWithinPartitions("part", "fp").write.parquet(f"{folder}/fps")
        distinct.select("fp", part_of("fp", parts).alias("part"), F.lit(parts).alias("parts")).groupBy("part").applyInArrow(_filter, "part int, parts int, bits binary").write.parquet(f"{folder}/blooms")

    def _prescreened(self, distinct: DataFrame, fine: int) -> DataFrame:
        """``(fp)`` of ``distinct(fp, times)`` that the filters may know or that occur more than once; a filter is asked by the fingerprints of its own partition only, of which a task has those of one in ``fine``."""
        out = []
        filters = self._read("blooms", "part int, parts int, bits binary")
        counts = [r.parts for r in filters.select("parts").distinct().collect()]  # powers of two, so few
        for parts in counts or [1]:
            tasks = max(parts, fine)
            mine = distinct.withColumn("part", part_of("fp", tasks))
            scale = tasks // parts
            theirs = filters.where(F.col("parts") == parts).select(F.explode(F.sequence(F.col("part") * scale, F.col("part") * scale + scale - 1)).alias("part"), "bits")
            out.append(mine.groupBy("part").cogroup(theirs.groupBy("part")).applyInArrow(_asked, "fp long"))
        return reduce(DataFrame.unionByName, out).distinct()

    def _hit_parts(self, maybe: DataFrame) -> DataFrame:
        """``(fp, rec)`` of the stored partitions that hold any of ``maybe``; each batch has its own number of them."""
        out = self.spark.createDataFrame([], "fp long, rec long")
        parts_of = {r.folder: r.parts for r in self._read("blooms", "part int, parts int, bits binary").select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]{32})/blooms", 1).alias("folder"), "parts").distinct().collect()}  # a row for each batch
        for folder in self.store.state()["outputs"]:
            parts = parts_of.get(folder.rsplit("/", 1)[-1], 1)
            stored = self.spark.read.schema(_STORED).parquet(f"{folder}/fps")
            if parts > 1:
                hit = [r.part for r in maybe.select(part_of("fp", parts).alias("part")).distinct().limit(parts).collect()]  # numbers of partitions
                stored = stored.where(F.col("part").isin(hit)) if len(hit) < parts else stored
            out = out.unionByName(stored.select("fp", "rec"))
        return out

    def merge(self) -> None:
        """Make one batch of all that were committed: the same records, links and frequencies, with filters made anew."""
        state = self.store.state()
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        self._kept(self.spark.read.schema("block int, counts binary").parquet(self._folders("frequency")[0]), f"{folder}/frequency")
        self._kept(self._read("sets", "rec long, tokens array<long>, content string"), f"{folder}/sets")
        self._kept(self._read("links", "b long, a long"), f"{folder}/links")
        old = self._read("fps", _STORED).select("fp", "rec")
        distinct = cut(old.select("fp").distinct(), "distinct")
        self._write_fingerprints(old, distinct, _parts(distinct), folder)
        self.store.publish(folder, Window(state["watermark"], state["watermark"]), replace=True)

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def links(self) -> DataFrame:
        """``(a, b)`` with ``a < b``: a record and an earlier one it repeats; copies are linked to their representative."""
        return self._read("links", "b long, a long").select("a", "b")

    def repeats(self) -> DataFrame:
        """``(first, rec)``: every record that repeats an earlier one, with the smallest record of its group."""
        links = cut(self.links(), "links")
        comps = components(links)
        return links.select(F.col("b").alias("rec")).distinct().join(comps.withColumnRenamed("node", "rec"), "rec").select(F.col("comp").alias("first"), "rec")
