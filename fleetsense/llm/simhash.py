"""SimHash near-duplicates by anchor-point covering: components of fingerprints that differ in few bits, exactly.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of the text's word shingles.

The anchors are the words of a covering code: a product of two perfect Golay codes over bits 0-22 and 23-45 and the one
word code over the other 18 bits, so that every fingerprint lies within radius (3, 3, 18) of exactly one anchor, its home,
of 2^24. Two fingerprints that differ in t bits are both within covering radius plus t of the home of either one, block
by block. So each fingerprint is replicated to every anchor within radius plus threshold, and at each anchor the ones at
home are compared with all that came. Anchors at which nobody is at home are left out: nothing is compared there.

What the driver holds and broadcasts is one byte per anchor (2^24 in all, at any input size): whether somebody is at home
and, where many are, in how many parts the anchor is split. A split anchor is compared part by part, all parts with all.
Equal fingerprints are one before they are replicated. A task returns a spanning forest of the links that it found.

Rows are documents of their own, also when they share a doc_id. Null, empty and wordless texts have fingerprint zero, which
links like any other. Null doc_ids never name a component unless it has no other. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sent, ship
from .jaccard import components
from .text import mix

PIECE = 1 << 20                 # bytes of a text that are split into words at a time
SEED = 42
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# The binary Golay code, as its generator polynomial.
GOLAY, LENGTH, CHECKS, RADIUS = 0xC75, 23, 11, 3
CODE = LENGTH - CHECKS          # bits that tell one word of the code
PAGE = 16                       # bits of an anchor inside a page of the map
FULL = 20_000                   # fingerprints at home in one part of an anchor, about
GATHER = 2_000_000              # entries that a task gathers before it deals them out
PER_RANGE = 2_000_000           # entries compared in one group, about
BLOCK = 4_000_000               # comparisons at a time


def votes(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: bytes, n: int) -> int:
    """Fingerprint of a whole text, read in pieces: a bit is set if over half of the n-word shingles' hashes have it."""
    at, carry, total, count = 0, [], np.zeros(64, np.int64), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            space = SPACE.search(text, end)
            end = space.start() if space else len(text)
        words = carry + text[at:end].translate(LOWER).split()
        at = end
        if len(words) >= n:
            flat = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            spans = zip((ends - size)[: len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)
            hashes = [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in spans]
            total += votes(hashes)
            count += len(hashes)
        carry = words[-(n - 1):] if n > 1 else []
    if not count and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * total > count).tolist())


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            bits = [simhash(b"" if (x := text[i].as_py()) is None else x, n) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))], ["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def remainder(x: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if x >> i & 1:
            x ^= GOLAY << i - CHECKS
    return x


class Block:
    """One Golay block: the words of the code around a value, by how far they lie beyond the covering radius."""

    def __init__(self, beyond: int) -> None:
        checks = [remainder(1 << i) for i in range(LENGTH)]
        masks, syndromes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        weights = np.zeros(1, np.int64)
        for i, check in enumerate(checks):
            few = weights < RADIUS + beyond
            masks, syndromes = np.concatenate([masks, masks[few] | 1 << i]), np.concatenate([syndromes, syndromes[few] ^ check])
            weights = np.concatenate([weights, weights[few] + 1])
        self.high = np.zeros(1, np.int64)       # syndromes of the bits that tell the word
        for check in checks[CHECKS:]:
            self.high = np.concatenate([self.high, self.high ^ check])
        excess = np.maximum(weights - RADIUS, 0)
        self.patterns, self.first, self.count = [], [], []
        for e in range(beyond + 1):
            order = np.argsort(syndromes[excess == e], kind="stable")
            self.patterns.append(masks[excess == e][order])
            count = np.bincount(syndromes[excess == e], minlength=1 << CHECKS)
            self.count.append(count)
            self.first.append(np.cumsum(count) - count)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.high[x >> CHECKS] ^ (x & (1 << CHECKS) - 1)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times: i, and 0, 1, 2, ..."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(bits: np.ndarray, block: Block, beyond: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(index, anchor, home): the anchors within covering radius plus `beyond` bits of each fingerprint."""
    low = (bits & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    high = (bits >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    s, t = block.syndrome(low), block.syndrome(high)
    for i in range(beyond + 1):
        for j in range(beyond + 1 - i):
            n, m = block.count[i][s], block.count[j][t]
            which, k = spread(n * m)
            one = block.patterns[i][block.first[i][s][which] + k // m[which]]
            two = block.patterns[j][block.first[j][t][which] + k % m[which]]
            yield which, (low[which] ^ one) >> CHECKS << CODE | (high[which] ^ two) >> CHECKS, not i + j


def occupied(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """One byte for each anchor: 0 if nobody is at home there, else 1 plus the logarithm of its parts; number of homes."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(0)
        for batch in batches:
            for _, anchor, _ in anchors(batch.column(0).to_numpy().view(np.uint64), block, 0):
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64())], ["anchor"])

    def page(rows: pa.Table) -> pa.Table:
        anchor, n = rows.column("anchor").to_numpy(), rows.column("n").to_numpy()
        out = np.zeros(1 << PAGE, np.uint8)
        out[anchor & (1 << PAGE) - 1] = 1 + np.ceil(np.log2(np.maximum(1, n / FULL))).astype(np.uint8)
        return pa.table({"page": pa.array([int(anchor[0]) >> PAGE], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "map": pa.array([zlib.compress(out.tobytes())], pa.binary())})

    counts = distinct.select("bits").mapInArrow(homes, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    pages = counts.groupBy(F.shiftright("anchor", PAGE).alias("page")).applyInArrow(page, "page long, n long, map binary").collect()
    out, total = np.zeros(1 << 2 * CODE, np.uint8), 0
    for p in pages:
        out[p.page << PAGE:p.page + 1 << PAGE] = np.frombuffer(zlib.decompress(p.map), np.uint8)
        total += p.n
    return out, total


def entries(bits: np.ndarray, block: Block, parts: np.ndarray, beyond: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, bits, home) of the replicated fingerprints. A cell is a pair of parts of an anchor: one of those at home, one of
    all that came."""
    for which, anchor, home in anchors(bits, block, beyond):
        here = parts[anchor] > 0
        which, anchor = which[here], anchor[here]
        if not len(which):
            continue
        log = parts[anchor].astype(np.int64) - 1
        part = (mix(bits[which]) & np.uint64(0xFFFF)).astype(np.int64) & (1 << log) - 1
        copy, k = spread(1 << log)
        cell = anchor[copy] << 32
        yield cell | k << 16 | part[copy], bits[which][copy], np.zeros(len(copy), bool)         # all that came, for each part at home
        if home:
            yield cell | part[copy] << 16 | k, bits[which][copy], np.ones(len(copy), bool)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as (a, b): each node with the least one of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    child = label != np.arange(len(nodes))
    return nodes[label[child]], nodes[child]


def compared(cell: np.ndarray, bits: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells between those at home and all that came; a link is looked at from its smaller end only."""
    order = np.lexsort((home, cell))
    cell, bits, home = cell[order], bits[order], home[order]
    one = np.flatnonzero(home)
    start = np.searchsorted(cell, cell[one])
    come = np.searchsorted(cell, cell[one], "right") - start
    a, b, at = [], [], 0
    work = np.cumsum(come)
    while at < len(one):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + BLOCK, "right")))
        which, k = spread(come[at:end])
        x, y = bits[one[at:end][which]], bits[start[at:end][which] + k]
        near = (np.bitwise_count(x ^ y) <= most) & (x < y)
        a.append(x[near])
        b.append(y[near])
        if sum(map(len, a)) > BLOCK:
            a, b = ([v] for v in forest(np.concatenate(a), np.concatenate(b)))
        at = end
    return forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def links(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b): a spanning forest, group by group, of the links between distinct fingerprints (bits)."""
    parts, total = occupied(distinct)
    # Anchors at random positions: each fingerprint reaches the share of its anchors that are homes.
    reach = len(Block(most).patterns[0]) and 1 + 300 * float((parts > 0).mean())
    ranges = max(1, int(total * reach / PER_RANGE))
    shared = sent(distinct.sparkSession, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, found, size = Block(most), pickle.loads(shared.value), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            cell, bits, home = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            to = (mix(cell.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            order = np.lexsort((cell, to))
            to, cell, bits, home = to[order], cell[order], bits[order], home[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            for x, y in zip(cut, [*cut[1:], len(to)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(to[x])], pa.int64()), *(pa.array([v[x:y].tobytes()], pa.binary()) for v in (cell, bits, home))], ["range", "cells", "bits", "home"])

        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(values), 2048):
                for e in entries(values[i:i + 2048], block, own, most):
                    found.append(e)
                    size += len(e[0])
                if size >= GATHER:
                    yield from out()
                    size = 0
        if found:
            yield from out()

    def compare(rows: pa.Table) -> pa.Table:
        cell, bits, home = (np.concatenate([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()]) for c, kind in (("cells", np.int64), ("bits", np.uint64), ("home", bool)))
        a, b = compared(cell, bits, home, most)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = distinct.select("bits").mapInArrow(deal, "range long, cells binary, bits binary, home binary")
    return dealt.groupBy("range").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id: the smallest doc_id reachable over fingerprints that
    differ in `most` (up to 3) bits or fewer. One row for each row of docs."""
    rows = saved(fingerprints(docs, n), "fingerprints")
    distinct = saved(rows.groupBy("bits").agg(F.min("doc_id").alias("head")), "distinct")
    found = saved(links(distinct, most), "links")
    named = distinct.select("bits", F.col("head").alias("component_id"))
    if not found.isEmpty():
        label = saved(components(found).join(distinct, F.col("doc") == F.col("bits")).select("bits", "label", "head"), "labels")
        least = label.groupBy("label").agg(F.min("head").alias("least"))
        least = label.join(least, "label").select("bits", "least")
        named = distinct.join(least, "bits", "left").select("bits", F.coalesce("least", "head").alias("component_id"))
    out = rows.join(named, "bits", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


ship(__name__)
