"""Reading folders of Markdown notes and writing them back; caches with an atomic swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorevine.functions import markdown as md
from lorevine.functions.ids import normalize_id
from lorevine.runtime import cut


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``(ord, id, content, modified_ms)`` of all ``.md`` files below ``root``, ids relative to it; unreadable files are skipped.

    ``ord`` follows the path order without gathering the rows: ranges of ids are counted and numbered within.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    files = reader.load(root).select(F.regexp_replace("path", r"^file:/+", "file:/").alias("path"), "content", F.unix_millis("modificationTime").alias("modified_ms"))
    notes = files.select(F.expr(f"substring(path, {len(base) + 1})").alias("id"), F.decode("content", "UTF-8").alias("content"), "modified_ms")
    # written once: counts and numbers must come from the same partitions
    ranged = cut(notes.repartitionByRange("id").withColumn("_p", F.spark_partition_id()), "files")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("id"))
    return ranged.withColumn("_i", place).join(counts, "_p").select((F.col("_before") + F.col("_i") - 1).alias("ord"), "id", "content", "modified_ms")


def parse(raw: DataFrame) -> DataFrame:
    """Notes of ``raw(ord, id, content)``: title, links, link types, tags, keywords, headings, importance."""
    columns = {
        "title": md.title(F.col("id"), F.col("content")), "wiki_links": md.links(F.col("content")), "wiki_link_types": md.link_types(F.col("content")), "tags": md.tags(F.col("content")),
        "headings": md.headings(F.col("content")), "importance": F.greatest(F.lit(0), F.least(F.lit(10), md.frontmatter_int(F.col("content"), "importance"))),
    }
    notes = raw.select("ord", "id", "content", *[c.alias(n) for n, c in columns.items()])
    words = keywords(raw)
    return notes.join(words, "id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def keywords(raw: DataFrame, most: int = md.MAX_KEYWORDS) -> DataFrame:
    """``(id, keywords)``: the most frequent words of each note, ties in alphabetical order."""
    counted = raw.select("id", F.explode(md.plain_words(F.col("content"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "word"))).where(F.col("r") <= most)
    return best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("keywords"))


def chunks(notes: DataFrame) -> DataFrame:
    """``(id, chunk_index, text)`` of all paragraphs that are long enough."""
    return notes.select("id", F.posexplode(md.paragraphs(F.col("content"))).alias("chunk_index", "text"))


def write_files(notes: DataFrame, root: str) -> None:
    """Write ``notes(id, content)`` as files below ``root``, a folder that all executors share; ids are normalised, so none leaves it."""
    base = root.rstrip("/")

    def save(rows):
        from pathlib import Path

        for row in rows:
            path = Path(base) / row.id
            path.parent.mkdir(parents=True, exist_ok=True)
            draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
            draft.write_text(row.content or "", encoding="utf-8")
            draft.replace(path)

    notes.select(normalize_id(F.col("id")).alias("id"), "content").foreachPartition(save)


class Snapshot:
    """A named table in versions: readers see the last one published, a writer's becomes visible by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/versions"))]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def read(self) -> DataFrame | None:
        """The published table; a missing one is None."""
        v = self.version()
        if not v:
            return None
        stream = self._fs.open(self._path(f"{self.path}/versions/{v}"))
        folder = json.loads(bytes(stream.readAllBytes()).decode())["folder"]
        stream.close()
        return self.spark.read.parquet(folder)

    def publish(self, df: DataFrame) -> int:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        v = self.version() + 1
        draft = self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(json.dumps({"folder": folder}).encode())
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.path}/versions/{v}")):
            raise RuntimeError(f"version {v} was published by another writer")
        return v
