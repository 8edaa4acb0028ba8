"""Every column of the fingerprint query against a plain version: neighbours, edited texts, sketches and likeness."""

import hashlib
import re
import struct
from itertools import pairwise

import duckdb
import xxhash

from fleetsense.llm import fingerprint, queries

FOLDER = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_sketch(text, k=fingerprint.K, n=fingerprint.WORDS):
    """XXH64 (seed 42) of each word, then of n of them in a row, each seeded by the one before; the k smallest."""
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    out = set()
    for i in range(max(1, len(words) - n + 1) if words else 0):
        h = 42
        for w in words[i:i + n]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        out.add(signed(h))
    return sorted(out)[:k]


def plain_likeness(a, b, k=fingerprint.K):
    whole = sorted({*a, *b})[:k]
    return len({*whole} & {*a} & {*b}) / len(whole) if whole else 1.0


def test_fingerprint_query_against_plain_version(spark):
    docs = sorted(((i, t or "") for i, t in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()), reverse=True)
    wanted = {}
    for (doc, text), (_, following) in pairwise([*docs, docs[0]]):
        cut = len(text) // 3
        changed = text[:len(text) - cut] + following[:cut]
        own, edited, near = plain_sketch(text), plain_sketch(changed), plain_sketch(following)
        hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
        wanted[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), hexed(own), hexed(edited), plain_likeness(own, edited), plain_likeness(own, near))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in queries.QUERIES["op5_fingerprints"](spark, FOLDER).collect()}
    assert got == wanted and len(got) == 200
