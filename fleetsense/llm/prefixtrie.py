"""Conversation prefix trie by truncation peeling: nodes of all shared beginnings, deepest first.

A turn is 20 bytes: half the SHA-256 of its role and text, and the length of the text in UTF-8. A sequence of turns is
their concatenation, so to strip its last turn is to cut 20 bytes, and texts are never shuffled.

1. Conversations that are wholly equal are merged first; the digest of the ids that end there is computed over sorted runs
   of ids, which tasks write in parallel and one streaming task per sequence joins, without holding them.
2. Of sequences of more than SHORT turns, what no other sequence shares is given out at once: in sorted order the longest
   shared beginning of a sequence is that with one of its neighbours. The nodes behind it belong to this sequence alone.
3. From the greatest depth that is left down to the root, the sequences that end at a depth are merged with the nodes that survived
   from below, stripped of their last turn. That one grouping makes the nodes of the depth and all sums of their subtrees.
   Each depth is written to the shared folder before the next one, so a lost executor costs one depth at most.
4. A node's parent is looked up by its own sequence without the last turn.

Turns with the same number follow each other by digest. Null roles and texts are empty. Rows with a null conv_id belong to
no conversation and are left out. Equal rows are turns of their own. Other columns are ignored. An empty table has no node.
A conversation's turns (20 bytes each) must fit into a row, and there is one job for each depth that sequences share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, work_folder

WIDTH = 20                      # bytes of a turn in a sequence
RUN = 8192                      # ids in one written run
SHORT = 16                      # turns up to which sequences are peeled turn by turn at any rate
NOTHING = hashlib.sha256().hexdigest()
TAIL = "done boolean, path binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LEVEL = "path binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of 40 hex digits per turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    item = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), item.alias("item")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["item"]).alias("turns"))


def spliced(lists: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 5 in place of its own; h = crc32(c) % 9."""
    lists = lists.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    heads = lists.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("head"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return lists.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def endings(sequences: DataFrame) -> DataFrame:
    """path, depth, conv_id (smallest), n_convs, ends_sha256 of each whole sequence, from rows (conv_id, path)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.binary()), "low": pa.array([ids[0]], pa.int64()), "n": pa.array([len(ids)], pa.int64()),
                                               "ids": pa.array([",".join(map(str, ids))], pa.string())})

        for batch in batches:
            for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (p != path or len(ids) >= RUN):
                    yield out()
                    ids = []
                path = p
                ids.append(i)
        if ids:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, low, total, digest = None, 0, 0, hashlib.sha256()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "depth", "conv_id", "n_convs", "ends_sha256"])

        for batch in batches:
            for p, first, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != path:
                    if path is not None:
                        done.append((path, len(path) // WIDTH, low, total, digest.hexdigest()))
                    path, low, total, digest = p, first, 0, hashlib.sha256()
                digest.update(("," * (total > 0) + ids).encode())
                total += n
            if len(done) >= 1000:
                yield out()
                done = []
        if path is not None:
            done.append((path, len(path) // WIDTH, low, total, digest.hexdigest()))
            yield out()

    dealt = sequences.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = dealt.mapInArrow(runs, "path binary, low long, n long, ids string")
    return parts.repartition("path").sortWithinPartitions("path", "low").mapInArrow(joined, "path binary, depth long, conv_id long, n_convs long, ends_sha256 string")


def shared_turns(a: bytes, b: bytes | None) -> int:
    """Number of turns with which both begin."""
    if b is None:
        return 0
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(v, np.uint8, n * WIDTH).reshape(n, WIDTH) for v in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def tails(ended: DataFrame) -> DataFrame:
    """What only one sequence of more than SHORT turns has, and what remains of it.

    done: a node behind the shared beginning; its path is that of its parent, for the first one only; the others have
    the same members as their parents. Not done: the shared beginning (path, depth), with the sums of what was cut off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(f.split() for f in TAIL.split(", ")), strict=True)
        types = [{"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[k] for k in kinds]

        def out(row: tuple, before: bytes | None, after: bytes | None) -> Iterator[pa.RecordBatch]:
            path, depth, low, n, ends = row
            cut = max(SHORT, shared_turns(path, before), shared_turns(path, after))
            sizes = np.ascontiguousarray(np.frombuffer(path, np.uint8).reshape(depth, WIDTH)[:, -4:]).view(">u4").ravel().astype(np.int64)
            saving = (n - 1) * np.cumsum(sizes[::-1])[::-1]
            k = depth - cut
            rows: list[tuple] = []
            if k:       # else another sequence goes on behind this one
                rows += zip([True] * k, [path[:cut * WIDTH]] + [None] * (k - 1), range(cut + 1, depth + 1), [low] * k, [n] * k, [1] * (k - 1) + [0], [1] * k,
                            saving[cut:].tolist(), [NOTHING] * (k - 1) + [ends], strict=True)
            rows.append((False, path[:cut * WIDTH], cut, low, n, int(k > 0), int(k > 0), int(saving[cut]) if k else 0, None if k else ends))
            for i in range(0, len(rows), RUN):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + RUN], strict=True), types, strict=True)], list(names))

        two = None, None        # the sequence before, and the one whose neighbour is awaited
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if two[1] is not None:
                    yield from out(two[1], two[0], row[0])
                two = (two[1][0] if two[1] is not None else None), row
        if two[1] is not None:
            yield from out(two[1], two[0], None)

    rows = ended.where(F.col("depth") > SHORT).select("path", "depth", "conv_id", "n_convs", "ends_sha256")
    return rows.repartition(F.substring("path", 1, SHORT * WIDTH)).sortWithinPartitions("path").mapInArrow(run, TAIL)


def peeled(ended: DataFrame) -> DataFrame | None:
    """All nodes, by depth; None if there are none. ended: written rows of endings(), or beginnings with sums of what was cut off."""
    spark = ended.sparkSession
    deepest = ended.agg(F.max("depth")).first()[0]
    if deepest is None:
        return None
    folder, below = work_folder(spark, "trie"), None
    for depth in range(deepest, -1, -1):
        rows = ended.where(F.col("depth") == depth).select("path", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        if below is not None:
            rows = rows.union(below.select(F.substring("path", 1, WIDTH * depth), "conv_id", "n_convs", F.lit(1).cast("long"), "n_leaves", "saved_tokens", F.lit(None).cast("string")))
        nodes = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends"))
        size = F.conv(F.hex(F.substring("path", -4, 4)), 16, 10).cast("long") if depth else F.lit(0).cast("long")
        nodes = nodes.select("path", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
                             (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
        nodes.write.parquet(f"{folder}/depth={depth}")
        below = spark.read.schema(LEVEL).parquet(f"{folder}/depth={depth}")
    return spark.read.schema(f"{LEVEL}, depth long").parquet(folder)


def trie(lists: DataFrame) -> DataFrame:
    """Nodes of the conversations in lists (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences = saved(lists.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path")), "sequences")
    ended = saved(endings(sequences), "endings")
    cut = saved(tails(ended), "tails")
    none = F.lit(0).cast("long")
    whole = ended.where(F.col("depth") <= SHORT).select("path", "depth", "conv_id", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"), "ends_sha256")
    nodes = peeled(whole.union(cut.where("not done").select(*whole.columns)))
    if nodes is None:
        return sequences.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = nodes.where("depth = 0").first().conv_id
    up = nodes.where("depth >= 1 and n_children > 0").select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [c for c in columns if c != "parent_conv_id"]
    deep = nodes.where("depth >= 2").select(F.expr(f"substring(path, 1, length(path) - {WIDTH})").alias("up"), *sums)
    deep = deep.union(cut.where("done and path is not null").select(F.col("path").alias("up"), *sums)).join(up, "up", "left")
    near = nodes.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).cast("long"))
    alone = cut.where("done and path is null").withColumn("parent_conv_id", F.col("conv_id"))
    return deep.select(*columns).union(near.select(*columns)).union(alone.select(*columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(turn_lists(conversations))


ship(__name__)
