"""Substring dedup by content-defined chunks with a gear rolling hash.

A text's bytes run through a gear hash, h = 2 h + gear[byte], of which the last WINDOW bytes matter. Where its upper bits
are zero a chunk ends, so an insertion moves no later chunk ends. Chunks are deduplicated by digest: the first occurrence
(smallest doc_id, then offset) is kept. A chunk that occurs elsewhere may be chance; runs of repeated chunks of at least
min_bytes are repeated passages.

Null texts are empty and have no chunks. Rows that share a doc_id are told apart by their texts. Equal rows are one, with the
number of them as copies; they repeat each other, so their whole text is a repeated passage, and kept_bytes counts the one
that is kept. Null doc_ids take part and sort first. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_rows, saved, ship
from .text import byte_keys, mix, texts

WINDOW = 16                     # bytes that decide about a cut
MASK_BITS = 5                   # a cut every 32 bytes on average
LEAST, MOST = 8, 4096           # bytes of a chunk


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte, by doubling: the sum over 2w bytes is that over w, plus the one before it shifted."""
    h = byte_keys(23)[data] & np.uint64(0xFFFFFFFF)
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint64(width)
        width *= 2
    return h & np.uint64(0xFFFFFFFF)


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk ends of one text. LEAST and MOST are measured from the last cut."""
    ends = np.flatnonzero(gear(data) >> np.uint64(32 - MASK_BITS) == 0) + 1
    out, last = [], 0
    for e in [*ends.tolist(), len(data)]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == len(data) and e > last:
            out.append(e)
            last = e
    return np.array(out, np.int64)


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of the chunks of one text."""
    starts = np.concatenate([[0], ends[:-1]])
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(MOST, np.uint64(0xD6E8FEB86659FD93))]))
    sizes = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(mix(data.astype(np.uint64) + np.uint64(1)) * power[place], starts)
    return mix(sums + sizes.astype(np.uint64))


def chunk_table(docs: DataFrame) -> DataFrame:
    """row, doc_id, copies, start, size, digest: the chunks of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in texts(batch.column(3)):
                rows, start, size, digest = [], [], [], []
                for i in range(end - first):
                    own = data[offsets[i]:offsets[i + 1]]
                    if len(own):
                        e = cuts(own)
                        rows.append(np.full(len(e), first + i))
                        start.append(np.concatenate([[0], e[:-1]]))
                        size.append(np.diff(e, prepend=0))
                        digest.append(digests(own, e).view(np.int64))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (start, size, digest))],
                                                     ["row", "doc_id", "copies", "start", "size", "digest"])

    rows = distinct_rows(docs).select("row", "doc_id", "copies", "text")
    return rows.mapInArrow(run, "row long, doc_id long, copies long, start long, size long, digest long")


def repeats(docs: DataFrame, min_bytes: int = 64) -> DataFrame:
    """doc_id, start, size, chunks, kept_bytes, copies: the repeated passages of each document, in bytes of its UTF-8 text.

    kept_bytes counts the bytes of the passage that are first occurrences, which dedup keeps. Digests are counted with
    map-side sums; only those seen twice go on, and a digest of very many documents is looked up in salted parts."""
    chunks = chunk_table(docs)
    least = F.min(F.struct("doc_id", "row", "start"))
    seen = chunks.groupBy("digest", "size").agg(F.sum("copies").alias("times"), least.alias("first")).where("times > 1").drop("times")
    salted = saved(seen, "repeated-chunks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    found = chunks.withColumn("salt", F.pmod(F.hash("row"), F.lit(4))).join(salted, ["digest", "size", "salt"])
    found = found.withColumn("kept", (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start")))
    order = Window.partitionBy("row", "doc_id", "copies").orderBy("start")
    found = found.withColumn("new", F.coalesce((F.lag(F.col("start") + F.col("size")).over(order) < F.col("start")).cast("int"), F.lit(1)))
    found = found.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = found.groupBy("row", "doc_id", "copies", "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("chunks"),
                                                      F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("kept_bytes"))
    return spans.where(F.col("size") >= min_bytes).select("doc_id", "start", "size", "chunks", "kept_bytes", "copies")


ship(__name__)
