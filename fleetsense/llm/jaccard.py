"""N-gram Jaccard join: links between near-duplicate texts by rare-first prefix filtering, exact to the last link.

A document is the set of its distinct n-word shingles, as 56-bit hashes. Equal sets are one class with one representative.
1. Shingles are counted over all representatives. A shingle of one text only can meet nothing, so only shared shingles
   come back: each text's list of them, rarest first. Its unique shingles stand before them in the global order.
2. Two sets with Jaccard >= t share a shingle in their first n - ceil(t n) + 1 places. Texts whose prefix is all unique
   are done. Length and positional filters look at sizes and places, a suffix filter compares the parts below and above
   a probe shingle; pairs that are left are verified once, on the shared shingles.
3. ``join`` gives out every link between representatives, and who is represented by whom. Pairs come from the posting
   lists of prefix shingles; a long list is cut into blocks, and each two blocks meet in a cell of their own, so no task
   holds more of a list than two blocks. Its rows grow with the square of a group of different near copies.
4. ``near_duplicates`` wants components only and need not see every link: every list first links its members with one
   pivot (the member with the least rarer shingles, in later turns one by hash). After those links are merged into
   components, only pairs of different components remain to be looked at, and all of these are.
5. ``with_links`` adds every document's number of links. All links lie inside components, so each two blocks of a component
   meet in one task, which counts the overlaps of their texts and gives out one number per text, no pairs.

Null, empty or wordless texts have no shingles and no links. Rows that share a doc_id are one document, with the text of
fewest shingles (then smallest signature). Null doc_ids give one row without a component. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .text import Hasher, grams, mix, texts

PER_RANGE = 500_000             # shingles counted by one task, about
FLUSH = 1_000_000               # shingles that a task gathers before it deals them out
COMMON = 127                    # document frequencies from here on rank alike, by hash
BITS = 56
MARK = np.int64(-1) << 62       # stands for COMMON documents of one task
SALTS = 32
TURNS = 3                       # pivots of a posting list
BLOCK = 1_000                   # members of a posting list in one block
CELL = 250_000                  # shared shingles of the texts in one block of a component


def shingles(batch: pa.RecordBatch, hasher: Hasher, column: int, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, end, data, offsets in texts(batch.column(column)):
        words, cut = hasher.words(data, offsets)
        for i in range(end - first):
            yield np.unique(grams(words[cut[i]:cut[i + 1]], n) >> np.uint64(64 - BITS))


def profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n, s1, s2: number of shingles of each row and a 128-bit signature of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sizes, one, two = [], [], []
            for s in shingles(batch, hasher, 2, n):
                sizes.append(len(s))
                one.append(int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, one, two))],
                                             ["doc_id", "text_hash", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long")


def deal(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """(range, docs, shingles): the shingles of all rows, packed by ranges of their hashes.

    A shingle that COMMON rows of one task share is sent once, and comes back to these rows under a negative range."""

    def pack(ids: np.ndarray, hashes: np.ndarray, task: int) -> Iterator[tuple[int, bytes, bytes]]:
        order = np.argsort(hashes, kind="stable")
        ids, hashes = ids[order], hashes[order]
        edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        count = np.diff(np.concatenate([edge, [len(hashes)]]))
        often = np.repeat(count >= COMMON, count)
        if often.any():
            yield task, planes(ids[often]), planes(hashes[often].astype(np.int64) | np.int64(COMMON) << BITS)
            marks = hashes[edge[count >= COMMON]]
            ids, hashes = np.concatenate([ids[~often], np.full(len(marks), MARK)]), np.concatenate([hashes[~often], marks])
            order = np.argsort(hashes, kind="stable")
            ids, hashes = ids[order], hashes[order]
        part = (((hashes >> np.uint64(BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
            yield int(part[a]), planes(ids[a:b]), planes(np.diff(hashes[a:b].astype(np.int64), prepend=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, ids, found, size, flushes = Hasher(), [], [], 0, 0
        task = TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            rows = pack(np.repeat(np.array(ids, np.int64), [len(x) for x in found]), np.concatenate(found), -1 - task - 100_003 * flushes)
            ids.clear()
            found.clear()       # pack holds its own copies
            for r, d, s in rows:
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([d], pa.binary()), pa.array([s], pa.binary())], ["range", "docs", "shingles"])

        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingles(batch, hasher, 1, n), strict=True):
                if len(s) and doc is not None:
                    ids.append(doc)
                    found.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield from out()
                    size, flushes = 0, flushes + 1
        if found:
            yield from out()

    return docs.mapInArrow(run, "range long, docs binary, shingles binary")


def planes(x: np.ndarray) -> bytes:
    """64-bit integers byte by byte: the high bytes of small numbers become runs that compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def shared(dealt: DataFrame) -> DataFrame:
    """(doc, rank) for the shingles that two or more documents have. rank holds the frequency, then the hash."""

    def count(rows: pa.Table) -> pa.Table:
        ids = [unplanes(x) for x in rows.column("docs").to_pylist()]
        coded = [unplanes(x) for x in rows.column("shingles").to_pylist()]
        if rows.column("range")[0].as_py() < 0:
            doc, rank = np.concatenate(ids), np.concatenate(coded)
        else:
            doc, rank = np.concatenate(ids), np.concatenate([np.cumsum(x) for x in coded])
            order = np.lexsort((doc, rank))
            doc, rank = doc[order], rank[order]
            new = np.concatenate([[True], rank[1:] != rank[:-1]])
            once = new | np.concatenate([[True], doc[1:] != doc[:-1]]) | (doc == MARK)
            doc, rank, new = doc[once], rank[once], new[once]
            edge = np.flatnonzero(new)
            times = np.add.reduceat(np.where(doc == MARK, COMMON, 1), edge)
            times = np.repeat(times, np.diff(np.concatenate([edge, [len(doc)]])))
            keep = (times >= 2) & (doc != MARK)
            doc, rank = doc[keep], np.minimum(times[keep], COMMON) << BITS | rank[keep]
        return pa.table({"doc": pa.array(doc, pa.int64()), "rank": pa.array(rank, pa.int64())})

    return dealt.groupBy("range").applyInArrow(count, "doc long, rank long")


def required(x: Column, y: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes with percent * union <= 100 * overlap."""
    return F.ceil((x + y) * percent / (100 + percent))


def near_sizes(x: Column, y: Column, percent: int) -> Column:
    return (x * 100 >= y * percent) & (y * 100 >= x * percent)


def may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether two sets that share a shingle at these places can be linked, by it.

    Sizes must be near; the shingle must be in the prefixes that the two sizes leave; and the shingles before it, without
    unique ones, and those from it on must suffice."""
    least = required(x["n"], y["n"], percent)
    reach = F.least(x["place"] - x["unique"], y["place"] - y["unique"]) + F.least(x["n"] - x["place"], y["n"] - y["place"])
    return near_sizes(x["n"], y["n"], percent) & (x["place"] <= x["n"] - least) & (y["place"] <= y["n"] - least) & (reach >= least)


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, their sizes and overlap. The suffix filter counts the shingles on both sides of a's middle one."""
    side = lambda s: live.select(F.col("doc").alias(s), F.col("n").alias(f"n_{s}"), F.col("ranks").alias(f"r_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("least", required(F.col("n_a"), F.col("n_b"), percent))
    probe = F.element_at("r_a", F.floor(F.size("r_a") / 2).cast("int") + 1)
    rows = rows.withColumn("probe", probe).withColumn("low_a", F.floor(F.size("r_a") / 2))
    rows = rows.withColumn("low_b", F.size(F.filter("r_b", lambda x: x < F.col("probe"))))
    above = F.least(F.size("r_a") - F.col("low_a"), F.size("r_b") - F.col("low_b"))
    rows = rows.where(F.least("low_a", "low_b") + above >= F.col("least"))
    rows = rows.withColumn("overlap", F.size(F.array_intersect("r_a", "r_b")).cast("long")).where(F.col("overlap") >= F.col("least"))
    return rows.select("a", "b", "n_a", "n_b", "overlap")


def pivot_pairs(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a pivot with the members of other components, in each posting list and class of sizes.

    In the first turn the pivot is the member with the least rarer shingles, then one by hash."""
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    rows = postings.withColumn("kind", kind)
    order = F.struct("place", "n", "unique", "doc", "label") if not turn else F.struct(F.xxhash64(F.lit(turn), "doc").alias("by"), "place", "n", "unique", "doc", "label")
    pivots = rows.groupBy("rank", "kind").agg(F.min(order).alias("p"), F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = rows.join(pivots, ["rank", "kind"]).where(F.col("label") != F.col("p.label"))
    one, two = ({c: F.col(side + c) for c in ("place", "n", "unique")} for side in ("", "p."))
    rows = rows.where(may_link(one, two, percent))
    return rows.select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()


def still_open(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their document, in lists that hold several components."""
    if labels is None:
        return postings.withColumn("label", F.col("doc"))
    rows = postings.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    lists = rows.groupBy("rank").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("rank")
    return saved(rows.join(lists, "rank"), "open-postings")


def rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share a prefix shingle and pass the length and positional filters.

    The first common shingle of a pair has the smallest place in both, so places are minima over the pair's lists. A pair
    that shares the shingle ahead of this one too has already met there, with the same room; it is not made again."""
    x, y = (rows.select("rank", *(F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "unique", "place", "label", "ahead"))) for s in "xy")
    one, two = ({c: F.col(f"{s}_{c}") for c in ("place", "n", "unique")} for s in "xy")
    both = x.join(y, (x["rank"] == y["rank"]) & (F.col("x_doc") < F.col("y_doc")) & (F.col("x_label") != F.col("y_label"))
                  & F.coalesce(F.col("x_ahead") != F.col("y_ahead"), F.lit(True)) & may_link(one, two, percent))
    pairs = both.groupBy(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).agg(
        F.min("x_place").alias("i"), F.min("y_place").alias("j"), F.first("x_n").alias("n"), F.first("y_n").alias("m"))
    return pairs.where(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= required(F.col("n"), F.col("m"), percent)).select("a", "b")


def cells(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two copies of the postings with columns row and column: two members of a list meet in one cell, the one of the
    lower block from the first copy and the other from the second; members of one block meet on the diagonal, both ways."""
    long = postings.groupBy("rank").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    long = long.select("rank", F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks"))
    rows = postings.join(long, "rank", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    low = rows.withColumn("row", F.col("block")).withColumn("column", F.explode(F.sequence("block", F.col("blocks") - 1)))
    high = rows.withColumn("column", F.col("block")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), "block")))
    return low, high


def all_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b), a < b, that share a prefix shingle and pass the length and positional filters, each once.

    A pair that shares the shingle ahead of this one too has already met there, with the same room; it is not made again."""
    x, y = (d.select("rank", "row", "column", *(F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "unique", "place", "ahead")))
            for s, d in zip("xy", cells(postings), strict=True))
    one, two = ({c: F.col(f"{s}_{c}") for c in ("place", "n", "unique")} for s in "xy")
    both = x.join(y, ["rank", "row", "column"]).where((F.col("row") < F.col("column")) | (F.col("x_doc") < F.col("y_doc")))
    both = both.where(F.coalesce(F.col("x_ahead") != F.col("y_ahead"), F.lit(True)) & may_link(one, two, percent))
    room = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    pairs = both.groupBy(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).agg(
        F.max(room).alias("room"), F.first(required(F.col("x_n"), F.col("y_n"), percent)).alias("least"))
    return pairs.where(F.col("room") >= F.col("least")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc, label): the smallest doc reachable over links (a, b), for docs with links.

    Alternating star steps: the larger neighbours of each document, then the smaller ones, are tied to the smallest one.
    Every step is written to the shared folder; it ends when nothing changes."""
    edges, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        edges = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(tied.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(edges, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("doc"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("label")).union(roots)


def prepared(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What both joins need: profiles of all rows, (doc_id, n, text_hash, head) of each document, lists of shared shingles
    and postings of the prefixes, these two for representatives that can meet another one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = saved(profile(docs.select("doc_id", "text_hash", "text"), n), "profiles")
    one = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "text_hash")).alias("w")).select("doc_id", "w.*")
    one = saved(one, "documents")
    # representatives of equal sets: partial minima by salted signature, then by signature, so no class meets in one task
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = one.where("n > 0").groupBy("n", "s1", "s2", salt.alias("salt")).agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size"))
    classes = (parts.groupBy("n", "s1", "s2").agg(F.min("head").alias("head"), F.sum("size").alias("size"), F.collect_set("salt").alias("salts"))
               .where("size > 1").select("n", "s1", "s2", "head", F.explode("salts").alias("salt")))
    member = saved(one.withColumn("salt", salt).join(classes, ["n", "s1", "s2", "salt"], "left")
                   .select("doc_id", "n", "text_hash", F.coalesce("head", "doc_id").alias("head")), "members")
    heads = member.where("n > 0 and doc_id = head")
    unused = saved(rows.where("doc_id is not null and n > 0").select("doc_id", "text_hash").distinct()
                   .join(heads.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti"), "unused")
    total = heads.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, min(1 << 20, -(-total // PER_RANGE)))
    fresh = docs.join(unused, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text")
    lists = shared(deal(fresh, n, ranges)).groupBy("doc").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    lists = lists.join(heads.select(F.col("doc_id").alias("doc"), "n"), "doc").withColumn("unique", F.col("n") - F.size("ranks"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    live = saved(lists.withColumn("open", (prefix - F.col("unique")).cast("int")).where("open > 0"), "live")
    postings = live.select("doc", "n", "unique", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.col("open"))).alias("i", "rank"))
    postings = saved(postings.select("rank", "doc", "n", "unique", (F.col("unique") + F.col("i")).alias("place"), F.get("ranks", F.col("i") - 1).alias("ahead")), "postings")
    return rows, member, live, postings


def labelled(postings: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(doc, label): the component of each linked representative."""
    labels = links = None
    for turn in range(TURNS):
        pairs = pivot_pairs(still_open(postings, labels), percent, turn)
        new = saved(verified(pairs, live, percent), "links")
        links = new if links is None else links.union(new)
        if turn and new.isEmpty():
            break
        labels = components(links)
    more = saved(verified(rest_pairs(still_open(postings, labels), percent), live, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, the document's own where it has none."""
    rows, member, live, postings = prepared(docs, n, percent)
    labels = labelled(postings, live, percent)
    out = member.join(labels.select(F.col("doc").alias("head"), "label"), "head", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "head").alias("component_id"))
    return out.union(without_id(rows).withColumn("component_id", F.lit(None).cast("long")))


def without_id(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id is null").groupBy("doc_id").agg(F.min("n").alias("n_shingles"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links (a, b, n_a, n_b, overlap), a < b, between classes of equal sets, each verified once; the membership
    (doc_id, n, head) of every document in its class, whose name is its smallest doc_id; and the profiles of all rows.

    Two documents link if their classes do, or if they are in one class and have shingles."""
    rows, member, live, postings = prepared(docs, n, percent)
    return saved(verified(all_pairs(postings, percent), live, percent), "all-links"), member.select("doc_id", "n", "head"), rows


def link_counts(texts: DataFrame, percent: int) -> DataFrame:
    """(head, degree), to be added up by head: how many documents of other classes link with it.

    ``texts``: head, n, ranks, label, size. The texts of a component are dealt into blocks by hash; two blocks meet in one
    cell, a block meets itself in another, so every pair of texts is compared in exactly one cell."""
    long = texts.groupBy("label").agg(F.sum(F.size("ranks")).alias("shingles")).where(F.col("shingles") > CELL)
    long = long.select("label", F.ceil(F.col("shingles") / CELL).cast("long").alias("blocks"))
    rows = texts.select("head", "n", "ranks", "label", "size").join(long, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"row": F.least("block", "other"), "column": F.greatest("block", "other")}).drop("blocks", "other")

    def count(cell: pa.Table) -> pa.Table:
        head, n, size, block = (cell.column(c).to_numpy() for c in ("head", "n", "size", "block"))
        low, high = (np.flatnonzero(block == cell.column(c)[0].as_py()) for c in ("row", "column"))
        alone = cell.column("row")[0].as_py() == cell.column("column")[0].as_py()
        lists = [x.values.to_numpy() for x in cell.column("ranks")]
        degree = np.zeros(len(head), np.int64)
        if len(low) and len(high):
            ranks, owner = np.concatenate([lists[y] for y in high]), np.repeat(np.arange(len(high)), [len(lists[y]) for y in high])
            order = np.argsort(ranks, kind="stable")
            ranks, owner = ranks[order], owner[order]
            for x in low:
                first, last = np.searchsorted(ranks, lists[x], "left"), np.searchsorted(ranks, lists[x], "right")
                times = last - first
                hits = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                overlap = np.bincount(owner[hits], minlength=len(high))
                linked = high[(100 * overlap >= percent * (n[x] + n[high] - overlap)) & (high != x)]
                degree[x] += size[linked].sum()
                if not alone:
                    degree[linked] += size[x]
        return pa.table({"head": pa.array(head[degree > 0], pa.int64()), "degree": pa.array(degree[degree > 0], pa.int64())})

    return rows.groupBy("label", "row", "column").applyInArrow(count, "head long, degree long")


def with_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links: the smallest doc_id reachable by links, the smallest with an
    equal set, and the number of other documents linked with this one. Documents without shingles stand alone, with no
    links; the row for null ids has nulls in the last three columns."""
    rows, member, live, postings = prepared(docs, n, percent)
    labels = saved(labelled(postings, live, percent).withColumnRenamed("doc", "head"), "labels")
    sizes = saved(member.where("n > 0").groupBy("head").agg(F.count(F.lit(1)).alias("size")), "class-sizes")
    texts = live.withColumnRenamed("doc", "head").join(labels, "head").join(sizes, "head")
    degrees = link_counts(texts, percent).groupBy("head").agg(F.sum("degree").alias("degree"))
    known = sizes.join(degrees, "head", "left").join(labels, "head", "left").where("size > 1 or degree is not null")
    out = member.join(known, "head", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "head").alias("component_id"), F.col("head").alias("class_id"),
        (F.coalesce("degree", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"))
    none = F.lit(None).cast("long")
    return out.union(without_id(rows).withColumns({"component_id": none, "class_id": none, "n_links": none}))


ship(__name__)
