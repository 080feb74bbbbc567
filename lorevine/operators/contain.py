"""Which documents hold all words of which queries, without a row for every word of every document.

Words become numbers. A query is looked for under its rarest word alone, and only documents that hold a word which some query is looked for under leave a row there. Each row carries a bitmap of all words of its
document or query, which rules most documents out inside the join; what is left is compared word by word, where the document lies.

Frequencies, bitmaps and filters have bounded sizes and steer cost only: no document that holds all words is lost, and none that lacks one is returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorevine.runtime import cut

#: Buckets of the word frequencies, bits of a filter sent to the tasks, longs of a bitmap of words, and queries that meet a document in one row.
BUCKETS, BITS, LONGS, TOGETHER = 1 << 19, 1 << 22, 4, 16
_MAP = [f"s{i}" for i in range(LONGS)]
_MAP_TYPE = ", ".join(f"{s} long" for s in _MAP)


def split(text: Column) -> Column:
    """The words of ``functions.words``, in two thirds of the time: what lies between other characters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _numbers(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda x: F.xxhash64(x))


def _lists(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that have words: the rows, the words of all, the row of each word, and the first word of each row."""
    sizes = np.diff(batch.column("w").offsets.to_numpy()).astype(np.int64)
    values = batch.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    some = sizes > 0
    sizes = sizes[some]
    return batch.filter(pa.array(some)), values, np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes


def _bitmaps(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    place = (values >> np.uint64(40)) & np.uint64(64 * LONGS - 1)
    bit = np.uint64(1) << (place & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == i, bit, np.uint64(0)), first).view(np.int64) for i in range(LONGS)]


def _sought(shared):
    """``(src, same, pivot, s0, ...)``: each query under its rarest word; queries with a word that no document has are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, owner, first = _lists(batch)
            if not rows.num_rows:
                continue
            times = shared.value[(values % np.uint64(BUCKETS)).astype(np.int64)]
            pivot = np.lexsort((values, times, owner))[first]
            yield pa.RecordBatch.from_arrays([rows.column("src"), rows.column("same"), pa.array(values[pivot].view(np.int64)), *map(pa.array, _bitmaps(values, first))], names=["src", "same", "pivot", *_MAP]).filter(pa.array(times[pivot] > 0))
    return run


def _passes(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) % np.uint64(BITS)
    return (field[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter(rows: DataFrame, column: str):
    """A filter of the numbers in a column; at most ``BITS`` numbers come to the driver."""
    bits = np.zeros(BITS, dtype=bool)
    bits[rows.select(F.pmod(column, F.lit(BITS)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    return rows.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))


def _holding(shared):
    """``(pivot, note, s0, ...)``: the documents under those of their words that the filter lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, owner, first = _lists(batch)
            if not rows.num_rows:
                continue
            hit = np.flatnonzero(_passes(shared.value, values))
            yield pa.RecordBatch.from_arrays([pa.array(values[hit].view(np.int64)), rows.column("note").take(pa.array(owner[hit])), *[pa.array(s[owner[hit]]) for s in _bitmaps(values, first)]], names=["pivot", "note", *_MAP])
    return run


def _kept(rows: DataFrame, number: str, shared) -> DataFrame:
    """The rows whose number the filter lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(shared.value, batch.column(number).to_numpy(zero_copy_only=False))))
    return rows.mapInArrow(run, StructType(rows.schema.fields))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, id, field, term, tf, dl, times)`` of the queries whose words a document all holds."""
    names = ["key", "id", "field", "term", "tf", "dl", "times"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part, out = batch.slice(at, 500), []
            for name, held, asks in zip(*(part.column(c).to_pylist() for c in ("id", "held", "asks")), strict=True):
                fields = [(x["field"], Counter(t := x["t"].split(" ")), len(t)) for x in held if x["t"]]
                known = set().union(*(count for _, count, _ in fields))
                for ask in asks:
                    wanted = Counter(ask["words"].split(" "))
                    if known.issuperset(wanted):
                        out += [(ask["key"], name, field, term, count[term], dl, times) for field, count, dl in fields for term, times in wanted.items() if term in count]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def holders(queries: DataFrame, documents: DataFrame, frequency: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Matches ``(key, id, field, term, tf, dl, times)`` of ``queries(src, text)`` among ``documents(id, held)`` with ``held`` an array of ``(field, value)``, and ``asked(src, key)``: queries of the same words share a key, one of their ``src``.

    ``tf`` counts a word in a field of ``dl`` words, ``times`` in the query. The document ``src`` itself is compared with a query of its own only where ``k`` others may match. ``frequency(term, df)`` has every word of the documents.
    """
    spark, queries = queries.sparkSession, cut(queries.where("src IS NOT NULL").select("src", "text"), "queries")
    counts = np.zeros(BUCKETS, dtype=np.float64)
    buckets = frequency.groupBy(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.sum("df").cast("double").alias("n")).toArrow()
    counts[buckets.column("bucket").to_numpy()] = buckets.column("n").to_numpy()
    same = F.unhex(F.sha2(F.concat_ws(" ", F.sort_array("words")), 256)).alias("same")
    sought = queries.select("src", split(F.col("text")).alias("words")).select("src", same, _numbers(F.col("words")).alias("w")).mapInArrow(_sought(spark.sparkContext.broadcast(counts)), f"src string, same binary, pivot long, {_MAP_TYPE}")
    alike = Window.partitionBy("same")
    asked = cut(sought.select("src", F.min("src").over(alike).alias("key"), F.count("*").over(alike).alias("members"), "pivot", *_MAP), "asked")
    single = asked.where("src = key").select("key", "members", "pivot", *[F.col(s).alias(f"q{s}") for s in _MAP])

    named = documents.where("id IS NOT NULL").withColumn("note", F.xxhash64("id"))
    holding = named.select("note", _numbers(F.flatten(F.transform("held", lambda x: split(x["value"])))).alias("w")).mapInArrow(_holding(_filter(single, "pivot")), f"pivot long, note long, {_MAP_TYPE}")
    covered = reduce(lambda a, b: a & b, [F.col(s).bitwiseAND(F.col(f"q{s}")) == F.col(f"q{s}") for s in _MAP])
    own = (F.col("members") == 1) & (F.col("note") == F.xxhash64("key"))
    pairs = cut(holding.join(single, "pivot").where(covered & ~own).select("key", "members", "note"), "pairs")
    full = pairs.where("members = 1").groupBy("key").count().where(F.col("count") >= k).select("key", F.xxhash64("key").alias("note"))
    pairs = cut(pairs.select("key", "note").unionByName(full).distinct().withColumn("number", F.xxhash64("key")), "pairs")

    words = _kept(queries.select(F.col("src").alias("key"), "text", F.xxhash64("src").alias("number")), "number", _filter(pairs, "number")).select("key", F.array_join(split(F.col("text")), " ").alias("words"))
    place = F.row_number().over(Window.partitionBy("note").orderBy("key"))
    asks = pairs.select("key", "note").join(words, "key").withColumn("slot", F.floor((place - 1) / TOGETHER)).groupBy("note", "slot").agg(F.collect_list(F.struct("key", "words")).alias("asks"))
    texts = _kept(named.select("id", "note", "held"), "note", _filter(pairs, "note")).select("id", "note", F.transform("held", lambda x: F.struct(x["field"].alias("field"), F.array_join(split(x["value"]), " ").alias("t"))).alias("held"))
    matches = texts.join(asks, "note").select("id", "held", "asks").mapInArrow(_compared, "key string, id string, field string, term string, tf long, dl long, times long")
    return matches, asked.select("src", "key")
