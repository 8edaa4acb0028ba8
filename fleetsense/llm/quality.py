"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels of 1) and unlabelled web text are all it learns from; labels of 0 are not used. The class prior
of the unlabelled text is estimated first: a classifier of positives against unlabelled text has odds of one to the prior
wherever all text is positive, so the prior is the median of these odds over positives that it was not fitted on. Then a
logistic model minimises the non-negative unbiased risk: prior * loss(positive as 1) plus the part of the unlabelled loss
as 0 that positives do not explain, which may not fall below zero.

Inputs are shapes of the whole text only: frequencies of pairs of byte kinds, repetition of words and lines, and lengths.
Null texts are empty texts and get a score like any other; so do null doc_ids, which are never learnt from. Without trusted
positives every score is 1. The fit sees at most `sample` positives and as many unlabelled documents, chosen by hash of the
id; of rows that share an id it sees the text with the least hash. Scoring covers every row, also repeated ones, without a
shuffle. All columns pass, whatever their names; the score's name is given.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sent, ship
from .text import Hasher, texts

SAMPLE = 10_000                 # bound of each side of the fit
KINDS = 15
WIDTH = KINDS * KINDS + KINDS + 9     # features
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def byte_kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, 14)
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",",
                               b";:?", b"!", b"#$%&*@^~+=", b"|\\/<>", b"\"'()[]{}`", b"-_"]):
        kind[list(chars)] = k
    kind[128:] = 13
    return kind


def shapes(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    kind, hasher, out = byte_kinds(), Hasher(), []
    for first, end, data, offsets in texts(column):
        words, cut = hasher.words(data, offsets)
        kinds = kind[data]
        pairs = kinds[:-1] * KINDS + kinds[1:]
        for i in range(end - first):
            a, b = offsets[i], offsets[i + 1]
            own = words[cut[i]:cut[i + 1]]
            n, m = max(1, b - a), max(1, len(own))
            freq = np.bincount(pairs[a:max(a, b - 1)], minlength=KINDS * KINDS) / n
            kept = np.bincount(kinds[a:b], minlength=KINDS) / n
            lines = bytes(data[a:b]).split(b"\n")
            distinct = len(np.unique(own))
            stats = [np.log1p(b - a), np.log1p(len(own)), distinct / m, np.log1p(distinct) / np.log1p(m), (b - a) / m,
                     len(set(lines)) / len(lines), np.log1p(len(lines)), len(lines) / m,
                     np.bincount(np.unique(own, return_inverse=True)[1]).max(initial=0) / m]
            out.append(np.concatenate([np.sqrt(freq), np.sqrt(kept), stats]))
    return np.array(out, np.float32).reshape(-1, WIDTH)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, width: int) -> np.ndarray:
    """Adam over a fixed number of steps."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled rows. Every fifth positive is kept out of the fit and gives the odds.

    It is bounded only so that it stays inside 0 and 1, by 0.0001."""
    out = np.arange(len(positive)) % 5 == 0
    fit = positive[~out] if (~out).any() else positive

    def gradient(w: np.ndarray) -> np.ndarray:
        return ((sigmoid(fit @ w) - 1) @ fit / len(fit) + sigmoid(unlabelled @ w) @ unlabelled / len(unlabelled)) / 2 + 10 * DECAY * w

    z = positive[out] @ descend(gradient, positive.shape[1])
    return float(np.clip(np.median(np.exp(-z)), 1e-4, 1 - 1e-4))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights with least non-negative unbiased risk under the logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        as_negative = np.logaddexp(0, unlabelled @ w).mean() - prior * np.logaddexp(0, positive @ w).mean()
        rest = u @ unlabelled / len(unlabelled) - prior * (p @ positive / len(positive))
        if as_negative < 0:         # step back out of the negative part instead of further into it
            return -rest + DECAY * w
        return prior * ((p - 1) @ positive / len(positive)) + rest + DECAY * w

    return descend(gradient, positive.shape[1])


class Model:
    """Standardised shapes into a score."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        both = np.vstack([positive, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = self.ready(positive), self.ready(unlabelled)
        self.prior = class_prior(p, u)
        self.weights = fit_risk(p, u, self.prior)

    def ready(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.ready(x) @ self.weights)


def measured(rows: DataFrame) -> np.ndarray:
    """Shapes of a bounded number of rows (text), on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in shapes(batch.column(0))], pa.binary())], ["shape"])

    got = rows.select("text").mapInArrow(run, "shape binary").toPandas()["shape"]
    return np.array([np.frombuffer(x, np.float32) for x in got], np.float32).reshape(len(got), WIDTH)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from at most `sample` trusted positives and as many unlabelled texts, by hash of doc_id."""
    order = F.xxhash64("doc_id")
    trusted = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    others = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(sample)
    # both sides hold at most `sample` ids, so a broadcast stays small
    def texts_of(ids: DataFrame) -> DataFrame:
        """One text for each id, so that the driver gets no more rows than ids."""
        found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
        return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    positive, unlabelled = measured(texts_of(trusted)), measured(texts_of(others))
    return Model(positive, unlabelled) if len(positive) and len(unlabelled) else None


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with a double column of that name, which docs must not have."""
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    packed = sent(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in batches:
            score = own.score(shapes(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


ship(__name__)
