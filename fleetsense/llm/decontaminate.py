"""Benchmark decontamination: BM25 over test items, block-max WAND, and a check of question and answer.

The items are the indexed documents, the passages of the corpus are the queries. Items are grouped by length: those of up
to L words are looked up with passages of 2L words that start every L words, so that an item lies whole in some passage.
Scores are divided by the item's score against itself, so one threshold holds for all. For each group:
1. whole texts are hashed word by word; words the index lacks weigh nothing, and a passage whose words' largest impacts
   stay below the threshold is passed over, first for all items, then for each block of items (block maxima), then by
   the full scores in the blocks that are left;
2. what is left goes through WAND: cursors over the posting lists, moved by pivots and skipping blocks whose maxima
   cannot reach the threshold; every item at or above it is retrieved;
3. a retrieved item counts when its question and its answer stand near the passage: enough of their word n-grams, or all
   words but one that is changed, put in or left out, so that one word cannot veto a short part.

Words are runs of letters and digits, so punctuation that is glued to them does not matter; items of punctuation only are
looked up by the words between white space.

A benchmark is read in shards of at most SHARD items, each with document frequencies of the whole benchmark; so what is
broadcast stays bounded. Items are plain texts: the answer is the last sentence, the question what stands before it; of a
single sentence both are halves. Null or empty texts and items match nothing. Items are keyed by id and text; those with one id are one result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, ship
from .text import Hasher, grams, texts

SHARD = 20_000                  # items in one index
BLOCK_ITEMS = 16                # items in one block of an index
K1, B = 1.2, 0.75
LEAST = 8                       # words of the shortest length group
GRAM = 3
LEAST_EDIT = 4                  # words, at least, in which one may differ
# First byte, range of the second, length of characters beyond ASCII that are mostly punctuation.
MARKS = [(0xC2, 0xA0, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3), (0xEF, 0xBC, 0xBC, 3)]


class LetterHasher(Hasher):
    """Hashes the runs of letters and digits of concatenated UTF-8 texts."""

    def __init__(self) -> None:
        super().__init__()
        self.keep = np.arange(256, dtype=np.uint8)
        self.keep[[i for i in range(128) if not chr(i).isalnum()]] = 32

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        clean = self.keep[data]
        for lead, low, high, size in MARKS:
            at = np.flatnonzero(data[:len(data) - size + 1] == lead) if len(data) >= size else np.zeros(0, np.int64)
            at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
            if lead == 0xEF:        # the full-width letters and digits stay
                at = at[data[at + 2] <= 0x8F]
            for i in range(size):
                clean[at + i] = 32
        return super().words(clean, offsets)


def words_of(texts_: list[str], kind: type[Hasher] = LetterHasher) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts, and where each text starts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts_]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return kind().words(np.frombuffer(b"".join(data), np.uint8), offsets)


def kind_of(text: str) -> type[Hasher]:
    """How the words of an item are told apart: by white space if it has no letters and digits."""
    return LetterHasher if len(words_of([text])[0]) else Hasher


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    ends = [m.end() for m in regex.finditer(r"[.?!]+(?=\s)|\n", text.strip())]
    if ends:
        return text.strip()[:ends[-1]], text.strip()[ends[-1]:]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2:])


def overlap(part: np.ndarray, region: np.ndarray) -> float:
    """Share of the part's n-grams that the region has; an empty part is there."""
    if not len(part):
        return 1.0
    n = min(GRAM, len(part))
    if len(region) < n:
        return 0.0
    return float(np.isin(np.unique(grams(part, n)), grams_of(region, n)).mean())


def one_edit(part: np.ndarray, region: np.ndarray) -> bool:
    """Whether the region has the part's words in order, but for one that is changed, put in or left out."""
    size, wide = len(part), len(region)
    # head[i], tail[j]: number of the part's first words from i on, and of its last words that end before j
    head, tail = np.zeros(wide + 3, np.int64), np.zeros(wide + 3, np.int64)
    for i in np.flatnonzero(region == part[0]):
        same = region[i:i + size] == part[:wide - i]
        head[i + 1] = len(same) if same.all() else same.argmin()
    for j in np.flatnonzero(region == part[-1]) + 1:
        same = region[max(0, j - size):j][::-1] == part[::-1][:j]
        tail[j + 1] = len(same) if same.all() else same.argmin()
    return any((head[:max(0, wide + 3 - gap)] + tail[gap:] >= least).any() for gap, least in ((size - 1, size - 1), (size, size - 1), (size + 1, size)))


def stands(part: np.ndarray, wider: np.ndarray, region: np.ndarray, share: float) -> tuple[bool, float]:
    """Whether a part of an item is in the region, and the share of its n-grams that are.

    One word may differ in parts of two words or more; of short ones, in the part and its neighbours in the item."""
    found = overlap(part, region)
    return found >= share or (len(part) > 1 and len(wider) >= LEAST_EDIT and one_edit(wider, region)), found


def grams_of(region: np.ndarray, n: int) -> np.ndarray:
    return grams(region, n) if len(region) >= n else np.zeros(0, np.uint64)


class Index:
    """Posting lists of the items of one length group, with block maxima. Impacts are shares of an item's own score."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], span: int, seen: dict[int, int], total: int, mean: float, kind: type[Hasher] = LetterHasher):
        self.span, self.items, self.kind = span, items, kind
        posting: dict[int, list[tuple[int, float]]] = {}
        for i, (_, words, _, _) in enumerate(items):
            terms, times = np.unique(words, return_counts=True)
            idf = np.log1p(np.array([(total - seen[int(t)] + 0.5) / (seen[int(t)] + 0.5) for t in terms]))
            part = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(words) / mean))
            for t, x in zip(terms.tolist(), (part / part.sum()).tolist(), strict=True):
                posting.setdefault(t, []).append((i, x))
        self.terms = np.array(sorted(posting), np.uint64)
        self.lists = [(np.array([i for i, _ in posting[t]]), np.array([x for _, x in posting[t]])) for t in self.terms.tolist()]
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.top = np.zeros((len(self.terms) + 1, self.blocks), np.float32)       # the last row stands for other words
        for k, (ids, impact) in enumerate(self.lists):
            np.maximum.at(self.top[k], ids // BLOCK_ITEMS, impact.astype(np.float32) * np.float32(1.000001))
        self.most = self.top.max(1)
        # the same impacts by block: rows of the block's terms, items within the block, impacts
        term = np.repeat(np.arange(len(self.lists)), [len(ids) for ids, _ in self.lists])
        item, impact = (np.concatenate([x[i] for x in self.lists]) for i in (0, 1))
        order = np.argsort(item // BLOCK_ITEMS, kind="stable")
        cut = np.searchsorted(item[order] // BLOCK_ITEMS, np.arange(1, self.blocks))
        self.inside = list(zip(*(np.split(x[order], cut) for x in (term, item % BLOCK_ITEMS, impact)), strict=True))

    def reached(self, terms: np.ndarray, threshold: float) -> bool:
        """Whether some item reaches the threshold: full scores in the blocks whose maxima allow it."""
        blocks = np.flatnonzero(self.top[terms].sum(0) >= threshold - 1e-6)
        if not len(blocks):
            return False
        there = np.zeros(len(self.terms), bool)
        there[terms] = True
        for b in blocks.tolist():
            term, item, impact = self.inside[b]
            if np.bincount(item, impact * there[term]).max() >= threshold - 1e-6:
                return True
        return False

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose score for a passage with these distinct terms reaches the threshold."""
        heads = [[0, k] for k in terms.tolist()]
        found = []
        while heads:
            heads.sort(key=lambda h: self.lists[h[1]][0][h[0]])
            bound, pivot = 0.0, -1
            for i, (_, k) in enumerate(heads):
                bound += self.most[k]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = self.lists[heads[pivot][1]][0][heads[pivot][0]]
            block = item // BLOCK_ITEMS
            while pivot + 1 < len(heads) and self.lists[heads[pivot + 1][1]][0][heads[pivot + 1][0]] == item:
                pivot += 1
            if sum(self.top[k, block] for _, k in heads[: pivot + 1]) < threshold:
                # no item of this block before the next list begins can reach it
                later = self.lists[heads[pivot + 1][1]][0][heads[pivot + 1][0]] if pivot + 1 < len(heads) else len(self.items)
                target, moved = min((block + 1) * BLOCK_ITEMS, later), heads[: pivot + 1]
            elif self.lists[heads[0][1]][0][heads[0][0]] == item:
                score = sum(self.lists[k][1][at] for at, k in heads[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((int(item), float(score)))
                target, moved = item + 1, heads[: pivot + 1]
            else:
                target, moved = item, [h for h in heads[:pivot] if self.lists[h[1]][0][h[0]] < item]
            for h in moved:
                h[0] += int(np.searchsorted(self.lists[h[1]][0][h[0]:], target))
            heads = [h for h in heads if h[0] < len(self.lists[h[1]][0])]
        return found

    def matches(self, words: np.ndarray, cut: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, end word, item, score) of all passages of some texts."""
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        place = np.where(self.terms[place] == words, place, len(self.terms))
        weight = self.most[place].astype(np.float64)
        size = np.diff(cut)
        count = np.maximum(1, -(-(size - self.span) // self.span)) * (size > 0)     # passages of 2 * span words, every span words
        text = np.repeat(np.arange(len(size)), count)
        first = cut[text] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * self.span
        end = np.minimum(first + 2 * self.span, cut[text + 1])
        total = np.concatenate([[0.0], np.cumsum(weight)])
        hot = np.flatnonzero(total[end] - total[first] >= threshold - 1e-6)
        for p in hot:
            a, b = int(first[p]), int(end[p])
            terms = np.unique(place[a:b])
            terms = terms[terms < len(self.terms)]
            if self.reached(terms, threshold):
                for item, score in self.wand(terms, threshold):
                    yield int(text[p]), a, b, item, score


def indexes(items: list[tuple[int, str, dict[int, int]]], total: int, mean: float) -> list[Index]:
    """Indexes by length group of the items (id, text, document frequency by word hash)."""
    groups: dict[tuple[int, bool], list] = {}
    seen: dict[int, int] = {}
    for item, text, found in items:
        seen |= found
        kind = kind_of(text)
        whole, question, answer = (words_of([t], kind)[0] for t in (text, *halves(text)))
        if len(whole):
            span = LEAST
            while span < len(whole):
                span *= 2
            groups.setdefault((span, kind is Hasher), []).append((item, whole, question, answer))
    return [Index(rows, span, seen, total, mean, Hasher if plain else LetterHasher) for (span, plain), rows in sorted(groups.items())]


def load(benchmark: DataFrame, shard: int = SHARD) -> Iterator[list[Index]]:
    """The indexes of one shard of the benchmark after the other. Word counts come from Spark, over all items."""
    kinds = "item_id long, text string, word long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of([text or ""], kind_of(text or ""))[0]
                terms = np.unique(words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array([text] * len(terms), pa.string()), pa.array(terms, pa.int64()),
                                                  pa.array([len(words)] * len(terms), pa.int64())], ["item_id", "text", "word", "n"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null").distinct()
    stats = rows.mapInArrow(run, kinds)
    total = rows.count()
    mean = stats.select("item_id", "text", "n").distinct().agg(F.avg("n")).first()[0] or 1.0
    often = stats.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    shards = max(1, -(-total // shard))
    whole = stats.join(often, "word").groupBy("item_id", "text").agg(F.collect_list("word").alias("words"), F.collect_list("seen").alias("seen"))
    for k in range(shards):
        part = whole.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text").collect()
        yield indexes([(r.item_id, r.text, {w % (1 << 64): s for w, s in zip(r.words, r.seen, strict=True)}) for r in part], total, mean)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, share: float = 0.7) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passages: each item found in each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passages long"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passages"]
    out = None
    for shard in load(benchmark):
        packed = sent(spark, shard)

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(packed.value)
            hashers = {index.kind: index.kind() for index in own}
            for batch in batches:
                ids, best = batch.column(0).to_pylist(), {}
                for row, end, data, offsets in texts(batch.column(1)):
                    hashed = {kind: hasher.words(data, offsets) for kind, hasher in hashers.items()}
                    for index in own:
                        words, cut = hashed[index.kind]
                        for text, a, b, item, score in index.matches(words, cut, threshold):
                            number, whole, question, answer = index.items[item]
                            near = words[max(cut[text], a - index.span):min(cut[text + 1], b + index.span)]
                            asked, q = stands(question, whole[:max(len(question), LEAST_EDIT)], near, share)
                            told, r = stands(answer, whole[-max(len(answer), LEAST_EDIT):], near, share)
                            if asked and told:
                                old = best.get((row + text, number), (0.0, 0.0, 0.0, 0))
                                best[row + text, number] = (*max(old[:3], (score, q, r)), old[3] + 1)
                found = [(ids[row], number, *x) for (row, number), x in best.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names).cast(
                        pa.schema([*((n, pa.int64()) for n in names[:2]), *((n, pa.float64()) for n in names[2:5]), (names[5], pa.int64())]))

        part = rows.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
                                                F.max("answer_overlap").alias("answer_overlap"), F.sum("passages").alias("passages"))


ship(__name__)
