"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (key, docs) bucketed and sorted by key, so runs join by merging, without an exchange. Each batch of
documents is counted per key, merge-anti-joined with the settled run (keys already known to be in enough documents, which
need no more counting) and added as a new run of level 0. When a level has `fanout` runs they are compacted into one of
the next level; keys that reach the limit there move to the settled run.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends and with A-Z lower-cased; runs hold its MD5.
Null text is one empty line. Empty keys never lose lines. Rows that share a doc_id count as one document, so do those
without one; each of them loses its lines. All columns pass, whatever their names; an empty table gives an empty result.
The tables of a use are dropped when it ends.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, work_folder

SALTS = 16                      # parts of a line that many documents share, when dropped lines are looked up


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: Column | None = None, text: Column | None = None) -> Column:
    """Identity of a row by its id and text; equal rows lose the same lines, so they may share it."""
    doc_id, text = F.col("doc_id") if doc_id is None else doc_id, F.col("text") if text is None else text
    return F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text)


class LineRuns:
    """Counts, over all batches added so far, of the documents that hold each line key."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder, self.tag = work_folder(spark, "lines"), uuid.uuid4().hex[:12]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.settled: list[str] = []
        self.names: list[str] = []
        self.made = 0

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_: object) -> None:
        """Drop the tables of the runs. Their files stay until the shared folder is cleared: rows may still be read from them."""
        for k in self.names:
            self.spark.sql(f"drop table if exists {k}")

    def write(self, rows: DataFrame, what: str) -> str:
        """A sorted, bucketed run; one file for each bucket."""
        self.made += 1
        name = f"run_{self.tag}_{what}_{self.made}"
        self.names.append(name)
        (rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def rows(self, name: str) -> DataFrame:
        """A run as plain rows, to be united with others; a bucketed scan is only for merging joins."""
        return self.spark.read.schema("key binary, docs long").parquet(f"{self.folder}/{name}")

    def unsettled(self, rows: DataFrame) -> DataFrame:
        for name in self.settled:
            rows = rows.join(self.spark.table(name).hint("merge"), "key", "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """Add a batch: one row (key) for each document and distinct key of it."""
        fresh = self.unsettled(lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs")))
        self.place(0, self.write(fresh, "level0"))

    def place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            counts = saved(self.total(names), "compacted")
            self.settled.append(self.write(counts.where(F.col("docs") >= self.min_docs), "settled"))
            self.place(level + 1, self.write(counts.where(F.col("docs") < self.min_docs), f"level{level + 1}"))

    def total(self, names: list[str]) -> DataFrame:
        """Counts of several runs together, without keys that are settled meanwhile."""
        rows = self.rows(names[0])
        for name in names[1:]:
            rows = rows.union(self.rows(name))
        return self.unsettled(rows.groupBy("key").agg(F.sum("docs").alias("docs")))

    def common(self) -> DataFrame:
        """Keys found in at least min_docs documents."""
        names = [n for level in self.levels for n in level]
        out = saved(self.total(names).where(F.col("docs") >= self.min_docs).select("key"), "late-lines") if names else None
        for name in self.settled:
            rows = self.rows(name).select("key")
            out = rows if out is None else out.union(rows)
        return out


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """doc (a struct of all columns of docs, its text without the lines that min_docs or more documents share), n_lines,
    n_dropped: one row for each row of docs.

    Texts are split and keyed once; the documents are shuffled once, by row, to meet the places of their dropped lines.
    A line that many documents share is counted with map-side sums and looked up in SALTS parts."""
    spark = docs.sparkSession
    docs = docs.withColumn("text", text_of()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = docs.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    # the keys of a text sorted together with their places: the first of equal keys stands for the document in the runs
    keys = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("place")))
    keys = F.transform(F.filter(keys, lambda x: F.length(x.key) >= min_chars), lambda x: F.struct(F.unhex(F.md5(x.key)).alias("key"), x.place.alias("place")))
    keyed = rows.select("doc_id", row_key().alias("row"), F.sort_array(keys).alias("keys"))
    found = keyed.select("doc_id", "row", F.posexplode(F.transform("keys", lambda x, i: F.struct(
        x.key.alias("key"), x.place.alias("place"), ((i == 0) | (F.get("keys", i - 1).key != x.key)).alias("first")))).alias("i", "k"))
    shared = saved(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    twins = not shared.isEmpty()
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    found = found.select("row", "k.*", batch.alias("batch"), *(["doc_id"] if twins else []))
    path = work_folder(spark, "line-keys")
    found.write.partitionBy("batch").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    if twins:       # rows of one id are one document: each of its keys counts once
        shared = shared.select("doc_id", F.lit(True).alias("shared"))
        found = found.join(shared, found["doc_id"].eqNullSafe(shared["doc_id"]), "left").select(found["*"], F.coalesce("shared", F.lit(False)).alias("shared"))
    with LineRuns(spark, min_docs) as runs:
        for b in range(batches):
            own = found.where((F.col("batch") == b) & F.col("first"))
            runs.add(own.where("not shared").select("key").union(own.where("shared").select("key", "doc_id").distinct().select("key")) if twins else own.select("key"))
        common = saved(runs.common(), "common-lines")
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (found.withColumn("salt", F.pmod(F.hash("row", "place"), F.lit(SALTS))).join(salted, ["key", "salt"], "left_semi")
               .groupBy("row").agg(F.collect_set("place").alias("places")))
    own = row_key(F.col("doc.doc_id").cast("long"), F.col("doc.text"))
    out = docs.withColumn("row", own).join(dropped, "row", "left").withColumn("lines", F.split("doc.text", "\n", -1))
    # the places that stay, by hashing; lines is used twice, so Spark splits a text once and not once a line
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("doc.text")).otherwise(kept)
    return out.select(F.col("doc").withField("text", text).alias("doc"), F.size("lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
