"""Values, not only counts, on inputs that operators and stages claim to handle: clashing columns, repeated rows, shared and
null ids, long texts, empty tables."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetsense.llm import bpe, chat, chunks, linededup, quality, queries, tokencount, warc

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["row", "places", "n_lines", "n_dropped", "score", "row_id", "doc", "key", "label", "salt", "lines", "keys", "batch", "first", "shared", "text_hash"]


def docs_of(spark, rows):
    """(doc_id, text) rows of all columns that the operators use inside, each with a value of its own."""
    return spark.createDataFrame([(i, t, len(t or ""), *range(len(EXTRA))) for i, t in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA))


def same_extras(rows):
    return all(r[c] == k for r in rows for k, c in enumerate(EXTRA))


def test_line_stage_keeps_clashing_columns(spark):
    rows = [(i, "shared line\nown %d" % i) for i in range(12)] + [(None, "shared line\nnull id"), (50, None)]
    got = corpus_pipeline.drop_lines(spark, docs_of(spark, rows), "").collect()
    assert same_extras(got) and {r.doc_id: r.text for r in got} == {i: "own %d" % i for i in range(12)} | {None: "null id", 50: ""}
    assert corpus_pipeline.drop_lines(spark, docs_of(spark, []), "").collect() == []


def test_line_dedup_counts_documents_once(spark):
    rows = [(1, "said ten times")] * 10 + [(2, "two ids\nx"), (2, "two ids\ny")] + [(None, "without an id")] * 3
    got = linededup.drop_common_lines(docs_of(spark, rows), min_docs=2).collect()
    assert len(got) == len(rows) and all(r.n_dropped == 0 for r in got)
    rows.append((3, "Two ids "))
    got = [(r.doc.doc_id, r.doc.text, r.n_lines, r.n_dropped) for r in linededup.drop_common_lines(docs_of(spark, rows), min_docs=2).where("doc.doc_id in (2, 3)").collect()]
    assert sorted(got) == [(2, "x", 2, 1), (2, "y", 2, 1), (3, "", 1, 1)]


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    start = time.monotonic()
    got = linededup.drop_common_lines(docs_of(spark, [(1, text), (2, text + "\nown")]), min_docs=2).collect()
    assert {r.doc.doc_id: (r.doc.text, r.n_dropped) for r in got} == {1: ("", 200_000), 2: ("own", 200_000)}
    assert time.monotonic() - start < 60
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_stages_keep_clashing_columns_and_rows_of_shared_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(90))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").orderBy(F.length("text").desc()).first().text
    rows = [(1, words), (2, words), (2, other), (7, "seven " + other[::-1]), (7, "seven " + other[::-1]), (None, words), (None, None), (4, ""), (5, "")]
    got = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, words), (2, other), (7, "seven " + other[::-1]), (None, None), (4, ""), (5, "")], key=repr)
    assert same_extras(got)
    rows = [(1, words), (2, f"a {item} b"), (2, other), (None, f"x {item} y"), (None, other)]
    got = corpus_pipeline.drop_leaks(spark, docs_of(spark, rows), FOLDER).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, words), (2, other), (None, other)], key=repr) and same_extras(got)
    got = corpus_pipeline.keep_quality(spark, docs_of(spark, [(1, words), (1, words), (None, None)]), FOLDER).collect()
    assert same_extras(got)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_chunks_of_repeated_rows(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(959))
    got = chunks.repeats(docs_of(spark, [(1, text), (1, text), (2, None), (3, "")])).collect()
    assert [(r.doc_id, r.start, r.size, r.kept_bytes, r.copies) for r in got] == [(1, 0, 959, 959, 2)]
    got = chunks.repeats(docs_of(spark, [(1, text), (1, text), (None, "x" + text)])).collect()
    assert {r.doc_id: r.copies for r in got} == {1: 2, None: 1}


def plain_chunks(data):
    """Gear hash byte by byte; a cut where its top bits are zero, at least LEAST and at most MOST bytes from the last."""
    keys, h, last, out = chunks.byte_keys(23), 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(keys[b] & np.uint64(0xFFFFFFFF))) & 0xFFFFFFFF
        sixteen = 0
        for x in data[max(0, i - 15):i + 1]:
            sixteen = ((sixteen << 1) + int(keys[x] & np.uint64(0xFFFFFFFF))) & 0xFFFFFFFF
        end = i + 1
        if end - last > chunks.MOST:
            out.append((last, last + chunks.MOST))
            last += chunks.MOST
        if (sixteen >> 27 == 0 and end - last >= chunks.LEAST) or end == len(data):
            out.append((last, end))
            last = end
    return out


def test_repeats_against_plain_chunks(spark):
    rng = random.Random(8)
    passage = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80, 300))) for _ in range(4)]
    texts = []
    for i in range(14):
        parts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(200))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passage) + parts[1] + (rng.choice(passage) if i % 2 else "") + parts[2])
    found, cuts = {}, {}
    for d, t in enumerate(texts):
        data = t.encode()
        cuts[d] = [(a, b, data[a:b]) for a, b in plain_chunks(data)]
        for a, _, piece in cuts[d]:
            found.setdefault(piece, []).append((d, a))
    wanted = []
    for d, own in cuts.items():
        run = None
        for a, b, piece in [*own, (None, None, None)]:
            if piece is not None and len(found[piece]) > 1:
                if run is None:
                    run = [d, a, 0, 0, 0]
                run[2] += b - a
                run[3] += 1
                run[4] += (b - a) * (min(found[piece]) == (d, a))
            elif run is not None:
                wanted += [tuple(run)] if run[2] >= 64 else []
                run = None
    got = [tuple(r)[:5] for r in chunks.repeats(docs_of(spark, list(enumerate(texts)))).collect()]
    assert sorted(got) == sorted(wanted) and wanted


def test_class_prior_is_returned_as_estimated():
    rng = np.random.default_rng(1)
    for prior in (0.02, 0.1, 0.5, 0.9):
        positive = np.hstack([rng.normal(1.5, 1, (4000, 6)), np.ones((4000, 1))])
        good = int(8000 * prior)
        unlabelled = np.vstack([rng.normal(1.5, 1, (good, 6)), rng.normal(-1.5, 1, (8000 - good, 6))])
        assert abs(quality.class_prior(positive, np.hstack([unlabelled, np.ones((8000, 1))])) - prior) < 0.03


def test_risk_never_follows_the_negative_part():
    rng = np.random.default_rng(2)
    positive = np.hstack([rng.normal(1, 1, (300, 4)), np.ones((300, 1))])
    unlabelled = np.hstack([rng.normal(0, 1.5, (300, 4)), np.ones((300, 1))])
    w = quality.fit_risk(positive, unlabelled, 0.95)        # far too high a prior: the unbiased risk would run below zero
    rest = np.logaddexp(0, unlabelled @ w).mean() - 0.95 * np.logaddexp(0, positive @ w).mean()
    assert rest > -0.05 and np.abs(w).max() < 20


def test_quality_of_repeated_rows_and_null_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    twice = docs.union(docs).union(docs.limit(3).select(F.lit(None).cast("long"), "text"))
    model = quality.fit(twice, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = quality.scored(twice.withColumn("score", F.lit(-1.0)), model, "good").collect()
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.good)
    assert len(got) == twice.count() and all(len(v) == 1 for v in by.values()) and all(r.score == -1.0 for r in got)


def test_warc_of_repeated_pages(spark):
    page = "<p>" + "x" * 2000
    rows = [(9, "b", page)] * 3 + [(9, "a", page), (5, "c", page), (None, "d", page), (9, "e", "<p>short"), (9, "e", "<p>short"), (3, None, None)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, keeper int, digest string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(9, "response", None), *[(9, "revisit", 9)] * 3, (5, "revisit", 9), (None, "response", None), *[(9, "response", None)] * 2, (3, "response", None)], key=repr)
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize(("record", "layout", "turns"), [
    ('{"instruction":"i","output":"o","text":"t","role":"user"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"prompt":"p","messages":[{"role":"user","content":"m"}],"completion":"c"}', "messages", [("user", "m")]),
    ('{"system":"s","prompt":"p","completion":"c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"messages":[],"id":3}', "messages", []),
    ('{"messages":[],"prompt":"p","response":"r"}', "messages", []),
    ('{"system":"s","prompt":"p","response":"r","text":null}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"text":"t","role":null}', "turn_row", [("", "t")]), ('{"text":"t"}', None, [])])
def test_chat_takes_the_most_specific_layout(spark, record, layout, turns):
    got = chat.canonical_turns(spark.createDataFrame([(1, record)], "k long, record string"), F.try_parse_json("record"), "k").orderBy("place").collect()
    assert got[0].layout == layout and [(r.role, r.text) for r in got if r.place is not None] == turns


def test_chat_of_long_null_and_no_turns(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "assistant", "&[INST]" * 100_000), (2, None, None, None)], "k long, i long, role string, text string")
    out = chat.format_conversations(turns, "k", "i")
    got = {r.k: (r.t, r.l) for r in out.select("k", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[None][0]] == [("user", "a"), ("assistant", "b")] and got[1][1] == "&[INST]" * 100_000 and [(t.role, t.text) for t in got[2][0]] == [("", "")]
    assert chat.format_conversations(turns.limit(0), "k", "i").collect() == []


def test_token_counts_of_a_long_pretoken(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    trie = tokencount.Trie(tokencount.vocabulary(path))
    rng = random.Random(6)
    for _ in range(30):
        word = "".join(rng.choice("etaoinshé") for _ in range(rng.randrange(1, 900)))
        assert trie.windowed(word) == trie.insert(word)
    text = "".join(rng.choice("etaoin") for _ in range(1_000_000))
    got = tokencount.count_tokens(docs_of(spark, [(1, text), (1, text), (None, None)]), path).collect()
    assert [(r.doc_id, r.n_pretokens) for r in got] == [(1, 1), (1, 1), (None, 0)] and got[0].n_tokens == got[1].n_tokens > 200_000


def test_bpe_of_repeated_rows_and_null_ids(spark):
    got = bpe.tokenize(docs_of(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]), queries.tokenizer_file()).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (None, 2), (2, 0)]
    assert {r.decoded_sha256 for r in got if r.n_tokens} == {hashlib.sha256(b"a b").hexdigest()}
