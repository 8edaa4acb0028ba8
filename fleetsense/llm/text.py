"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy inside Spark tasks.

A word is a longest run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; nothing else is folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ship

BLOCK = 1 << 20                 # bytes hashed at a time; bounds the memory of very long texts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_keys(seed: int) -> np.ndarray:
    """256 random-looking 64-bit values; the same for every task and run."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Hasher:
    """Hashes the words of concatenated UTF-8 texts."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.key = byte_keys(11)[lower]
        self.power = self.back = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            p = 0x9E3779B97F4A7C15 | 1
            self.power, self.back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(q))]))
                                     for q in (p, pow(p, -1, 1 << 64)))

    def block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; cuts are the text starts inside the block."""
        full = ~self.space[data]
        begin, end = full.copy(), full.copy()
        begin[1:] &= ~full[:-1]
        end[:-1] &= ~full[1:]
        begin[cuts] = full[cuts]
        end[cuts[cuts > 0] - 1] = full[cuts[cuts > 0] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.powers(max(len(data), 1))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.key[data] * self.power[: len(data)], out=total[1:])
        return starts, mix((total[ends] - total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of all texts, and the number of words before each text (one more entry than texts)."""
        starts, hashes, at, n = [], [], 0, len(data)
        while at < n:
            stop = min(n, at + BLOCK)
            if stop < n:            # cut at white space or where a text starts
                inside = np.flatnonzero(self.space[data[at:stop]])
                text = offsets[np.searchsorted(offsets, stop, "right") - 1]
                stop = max(int(text), at + int(inside[-1]) if len(inside) else 0)
                if stop <= at:
                    far = np.flatnonzero(self.space[data[at + BLOCK:]])
                    text = offsets[min(np.searchsorted(offsets, at, "right"), len(offsets) - 1)]
                    stop = min(int(text), at + BLOCK + int(far[0]) if len(far) else n)
            cuts = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop)] - at
            s, h = self.block(data[at:stop], cuts)
            starts.append(s + at)
            hashes.append(h)
            at = stop
        if not starts:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; fewer words: the whole sequence is one shingle; none: none."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - k + 1 + i]
    return mix(out)


def texts(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of rows with about `most` bytes; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        a, b = int(offsets[row]), int(offsets[end])
        yield row, end, data[a:b], offsets[row:end + 1] - a
        row = end


ship(__name__)
