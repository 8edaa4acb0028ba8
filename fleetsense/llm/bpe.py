"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every distinct pre-token of a task gets a tree whose leaves are the merge ranks of its adjacent pairs (with the position
as tie breaker). The root is the leftmost pair of lowest rank. A merge changes three leaves, so it costs a logarithmic
number of node updates; merging ends when no pair has a rank. Many pre-tokens of one length class go through their trees
side by side as rows of numpy arrays. Encoded pre-tokens are kept in a bounded table per task.

Null text is empty text: no ids, and the digests of nothing. Repeated rows give repeated results. Columns besides doc_id
and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, ship

# White space as Unicode defines it, and the split pattern of byte-level tokenizers.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+"
         .replace("WS", "".join(map(chr, WHITE))))
# Bytes that a byte-level vocabulary writes as themselves; the others follow from U+0100 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

NONE = np.int64(1) << 60        # a pair that no rule merges
ROWS = 4096                     # pre-tokens merged side by side
KEPT = 100_000                  # pre-tokens kept by a task; then the table starts anew
BYTES = 1 << 19                 # text encoded at a time
ROWS_READ = 256                 # texts turned into Python strings at a time


class Vocabulary:
    """Pair ranks and token bytes of a byte-level BPE file; a few megabytes, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        chars = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PLAIN))}
        raw = {c: b for b, c in chars.items()}
        self.first = np.array([ids[chars[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max(max(ids.values()), *self.special.values(), 0))
        for token, i in ids.items():
            self.bytes[i] = bytes(raw[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(key), 1)))) + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        slot, rank = self.slot(key), np.arange(len(key))
        while len(key):             # open addressing: the first of those that want a free slot gets it
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]], self.ranks[slot[won]] = key[won], rank[won]
            rest = np.setdiff1d(np.arange(len(key)), won)
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NONE where there is none or a side is missing (negative)."""
        key = left << 32 | right
        slot = self.slot(key)
        out = np.full(len(key), NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        while len(at):
            found = self.slots[slot[at]]
            hit = found == key[at]
            out[at[hit]] = self.ranks[slot[at[hit]]]
            at = at[~hit & (found >= 0)]
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for depth, rows in classes.items():
            step = max(1, min(ROWS, (ROWS * 32) >> depth))
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                for i, ids in zip(part, self.merge([words[i] for i in part], depth), strict=True):
                    out[i] = ids
        return out

    def merge(self, words: list[bytes], depth: int) -> list[bytes]:
        """Merge pre-tokens of at most 2**depth bytes through their segment trees."""
        n, m = 1 << depth, len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        data = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(m, n)
        token = np.where(np.arange(n) < lengths[:, None], self.first[data], -1)
        # one more column each: index n stands for "no neighbour" on the right and, as -1, on the left
        token = np.hstack([token, np.full((m, 1), -1)]).ravel()
        after = np.tile(np.arange(1, n + 2), (m, 1)).ravel()
        before = np.tile(np.arange(-1, n), (m, 1)).ravel()
        width = n + 1
        tree = np.full((m, 2 * n), NONE)
        wide = token.reshape(m, width)
        ranks = self.rank(wide[:, :-1].ravel(), wide[:, 1:].ravel()).reshape(m, n)
        tree[:, n:] = np.where(ranks < NONE, ranks * n + np.arange(n), NONE)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            tree[:, a:2 * a] = np.minimum(tree[:, 2 * a:4 * a:2], tree[:, 2 * a + 1:4 * a:2])
        tree = tree.ravel()
        row = np.arange(m)
        while True:
            root = tree[row * (2 * n) + 1]
            row, root = row[root < NONE], root[root < NONE]
            if not len(row):
                break
            base, leaf = row * width, row * (2 * n) + n
            left = root % n
            right = after[base + left]
            beyond, ahead = after[base + right], before[base + left]
            token[base + left] = self.merged[root // n]
            token[base + right] = -1
            after[base + left] = beyond
            before[base + np.minimum(beyond, n)] = left
            tree[leaf + right] = NONE
            has = ahead >= 0
            beyond = np.minimum(beyond, n)
            rank = self.rank(token[base + left], token[base + beyond])
            tree[leaf + left] = np.where(rank < NONE, rank * n + left, NONE)
            rank = self.rank(np.where(has, token[base + np.maximum(ahead, 0)], -1), token[base + left])
            ahead = np.where(has, ahead, left)
            tree[leaf + ahead] = np.where(has, np.where(rank < NONE, rank * n + ahead, NONE), tree[leaf + ahead])
            top = np.concatenate([row, row, row]) * (2 * n)
            node = np.concatenate([left, right, ahead]) + n
            for _ in range(depth):
                node >>= 1
                tree[top + node] = np.minimum(tree[top + 2 * node], tree[top + 2 * node + 1])
        wide = token.reshape(m, width)
        keep = wide >= 0
        ids, ends = wide[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Encoder:
    """Encodes texts with one vocabulary, keeping the pre-tokens it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.split = vocabulary, {}, regex.compile(SPLIT)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) or r"(?!)")

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str | bytes]] = []
        fresh: set[str] = set()
        if len(self.known) > KEPT:
            self.known = {}
        for text in texts:
            own: list[str | bytes] = []
            at = 0
            for hit in self.special.finditer(text):
                own += self.split.findall(text[at:hit.start()])
                own.append(self.vocabulary.special[hit[0]].to_bytes(4, "little"))
                at = hit.end()
            own += self.split.findall(text[at:] if at else text)
            parts.append(own)
            fresh.update(w for w in own if w not in self.known and isinstance(w, str))
        new = list(fresh)
        self.known.update(zip(new, self.vocabulary.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        return [b"".join([self.known[w] if isinstance(w, str) else w for w in own]) for own in parts]


def groups(texts: Iterable[str], most: int = BYTES) -> Iterator[list[str]]:
    """Consecutive texts of about `most` characters together."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def tokenize(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids themselves (array of int).

    No shuffle: each task encodes and decodes its own rows in groups of bounded size."""
    vocabulary = sent(docs.sparkSession, Vocabulary(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(vocabulary.value)
        encoder = Encoder(v)
        for batch in batches:
            at = 0
            column = batch.column(1).fill_null("")
            texts = (t for k in range(0, len(column), ROWS_READ) for t in column.slice(k, ROWS_READ).to_pylist())
            for part in groups(texts):
                coded = encoder.encode(part)
                out = [batch.column(0).slice(at, len(part)), pa.array([len(x) // 4 for x in coded], pa.int64()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                       pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in coded], pa.string())]
                if ids:
                    out.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


ship(__name__)
