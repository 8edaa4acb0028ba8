"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a task go into a trie. A node's forward score is the best score of any segmentation of its
path into vocabulary pieces: the best over the pieces that end there, each added to the forward score of the node where
it starts. A node is scored once, however many pre-tokens run through it; a pre-token's terminal node keeps the number of
pieces of its best segmentation. Documents then sum what their pre-tokens' terminals hold.

A pre-token is a run of characters without white space, with a mark for the space before it. Pieces score minus the
logarithm of their place in the vocabulary (Zipf's law); a character without a piece counts as one token with a fixed low
score. Of equal scores the segmentation with fewer pieces is taken. Null and empty texts have no tokens. The trie of a task
is bounded: beyond MOST nodes a new one is begun, which changes no count. A pre-token of more than LONG characters stays out
of the trie; it is scored over a window of the last forward scores. Other columns are ignored; every row has its own result.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, ship

MARK = "\u2581"                # stands for the space before a word
MOST = 1_500_000
LONG = 1_000                    # characters; longer pre-tokens share too little to be kept
UNKNOWN = -25.0


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and their scores from a sentencepiece file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(place + 2) for place, p in enumerate(pieces)}


class Trie:
    """Pre-tokens with shared prefixes. Per node: its children, forward score and number of pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.forward, self.pieces = [0.0], [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def insert(self, token: str) -> tuple[int, float]:
        """Pieces and score of a pre-token; new nodes are scored on the way."""
        if len(token) > LONG:
            return self.windowed(token)
        node, path = 0, [0]
        for depth, char in enumerate(token, 1):
            following = self.children[node].get(char)
            if following is None:
                following = len(self.forward)
                self.children[node][char] = following
                self.children.append({})
                best, count = self.forward[node] + UNKNOWN, self.pieces[node] + 1
                for start in range(max(0, depth - self.longest), depth):
                    own = self.scores.get(token[start:depth])
                    if own is not None:
                        value, n = self.forward[path[start]] + own, self.pieces[path[start]] + 1
                        if value > best or value == best and n < count:
                            best, count = value, n
                self.forward.append(best)
                self.pieces.append(count)
            node = following
            path.append(node)
        return self.pieces[node], self.forward[node]


    def windowed(self, token: str) -> tuple[int, float]:
        """The same for one long pre-token, holding as many forward scores as the longest piece has characters."""
        best = deque([(0.0, 0)], maxlen=self.longest)
        for end in range(1, len(token) + 1):
            value, count = best[-1][0] + UNKNOWN, best[-1][1] + 1
            for back in range(1, len(best) + 1):
                own = self.scores.get(token[end - back:end])
                if own is not None:
                    v, n = best[-back][0] + own, best[-back][1] + 1
                    if v > value or v == value and n < count:
                        value, count = v, n
            best.append((value, count))
        return best[-1][1], best[-1][0]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (sum of the best forward scores). No shuffle."""
    scores = sent(docs.sparkSession, vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pickle.loads(scores.value))
        for batch in batches:
            words, tokens, total = [], [], []
            for text in batch.column(1).fill_null("").to_pylist():
                n, t, s = 0, 0, []
                for word, times in Counter(text.split()).items():
                    got = trie.terminal.get(word)
                    if got is None:
                        if len(trie.forward) > MOST:
                            trie.clear()
                        got = trie.terminal[word] = trie.insert(MARK + word)
                    n += times
                    t += times * got[0]
                    s.append(times * got[1])
                words.append(n)
                tokens.append(t)
                total.append(math.fsum(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(total, pa.float64())],
                                             ["doc_id", "n_pretokens", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


ship(__name__)
