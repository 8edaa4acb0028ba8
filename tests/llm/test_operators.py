"""Each training-data operator against SQL, a brute-force version, an exact round trip or held-out accuracy."""

import io
import math
import random
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetsense.llm import bpe, chat, chunks, decontaminate, fingerprint, jaccard, linededup, quality, queries, tokencount, warc

FOLDER = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, row long, score double, key string, label long, salt int"


def table(name):
    return duckdb.sql(f"select * from '{FOLDER}/{name}.parquet'").fetchall()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5, "k", 2, 3) for i, t in rows], EXTRA)


ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"),
       (6, "one two three four five six"), (-7, "x" * 70_000), (8, "word " * 30_000), (9, "ÄÖ ß\n\nline\x0b\n LINE ")]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in cur.description)
    wanted = sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()))
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == wanted


def test_odd_rows_and_empty_tables(spark):
    odd, none = docs_of(spark, ODD), docs_of(spark, [])
    bench = spark.createDataFrame([(0, "one two three four five six"), (1, None), (None, "x"), (2, "")], "item_id long, text string")
    runs = [lambda d: linededup.drop_common_lines(d, min_docs=2), jaccard.near_duplicates, lambda d: decontaminate.leaks(d, bench),
            lambda d: tokencount.count_tokens(d, queries.tokenizer_file("piece_bpe_32k.model")), fingerprint.with_next, chunks.repeats,
            lambda d: quality.scored(d, None), lambda d: bpe.tokenize(d, queries.tokenizer_file())]
    sizes = [len(run(odd).collect()) for run in runs]
    assert [len(run(none).collect()) for run in runs] == [0] * len(runs)
    assert sizes[0] == sizes[3] == sizes[4] == sizes[6] == sizes[7] == len(ODD)
    assert sizes[1] == len({i for i, _ in ODD})
    near = {r.doc_id: r for r in jaccard.near_duplicates(odd).collect()}
    assert near[5].component_id == near[6].component_id == 5 and near[1].n_shingles == 0 and near[None].component_id is None
    assert {(r.doc_id, r.item_id) for r in runs[2](odd).collect()} == {(5, 0), (6, 0)}


def test_line_runs_over_many_batches(spark):
    random.seed(5)
    sets = [{f"l{random.randrange(40)}" for _ in range(5)} for _ in range(60)]
    runs = linededup.LineRuns(spark, 8)
    for k in range(0, 60, 10):
        runs.add(spark.createDataFrame([(x.encode(),) for s in sets[k:k + 10] for x in s], "key binary"))
    wanted = {f"l{i}" for i in range(40) if sum(f"l{i}" in s for s in sets) >= 8}
    assert {bytes(r.key).decode() for r in runs.common().collect()} == wanted and wanted
    assert runs.settled and len(runs.levels) > 1


def shingle_sets(texts, n):
    return [frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if (w := t.lower().split()) else frozenset() for t in texts]


@pytest.mark.parametrize("turns", [0, 3])
def test_jaccard_join_against_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(jaccard, "TURNS", max(turns, 1))
    if not turns:       # nearly all links are then left to the pairs of different components
        monkeypatch.setattr(jaccard, "pivot_pairs", lambda rows, percent, turn: rows.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0))
    random.seed(7)
    base = [[f"w{random.randrange(300)}" for _ in range(random.randrange(3, 60))] for _ in range(8)]
    texts = []
    for _ in range(160):
        w = list(random.choice(base))
        for _ in range(random.randrange(4)):
            w[random.randrange(len(w))] = f"n{random.randrange(50)}"
        texts.append(" ".join(w))
    sets, root = shingle_sets(texts, 4), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = jaccard.near_duplicates(docs_of(spark, list(enumerate(texts))), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_wand_retrieves_what_a_full_scan_does(spark):
    random.seed(2)
    words = [f"w{int(random.paretovariate(0.6)) % 400}" for _ in range(40_000)]
    items = [(i, " ".join(words[i * 50:i * 50 + random.randrange(9, 40)]), {}) for i in range(60)]
    hashed = [decontaminate.words_of([t])[0] for _, t, _ in items]
    seen = {}
    for h in hashed:
        for t in set(h.tolist()):
            seen[t] = seen.get(t, 0) + 1
    for index in decontaminate.indexes([(i, t, seen) for i, t, _ in items], len(items), 25.0):
        passages = [" ".join(random.sample(words, 20) + items[random.randrange(60)][1].split()[: random.randrange(30)]) for _ in range(40)]
        own, cut = decontaminate.words_of(passages)
        got = {(t, a, i): s for t, a, _, i, s in index.matches(own, cut, 0.3)}
        wanted = {}
        for t in range(len(passages)):
            for a in range(cut[t], max(cut[t] + 1, cut[t + 1] - index.span), index.span):
                here = set(own[a:min(a + 2 * index.span, cut[t + 1])].tolist())
                for i in range(len(index.items)):
                    s = sum(float(x[ids == i][0]) for term, (ids, x) in zip(index.terms.tolist(), index.lists, strict=True) if term in here and (ids == i).any())
                    if s >= 0.3:
                        wanted[t, a, i] = s
        assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k], abs_tol=1e-6) for k in got)


def test_leaks_finds_planted_items_only(spark):
    bench = table("benchmark")
    docs = table("documents")
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontaminate"](spark, FOLDER).collect()}
    plain = {(d[0], i) for d in docs for i, t in bench if " ".join(t.lower().split()) in " ".join((d[1] or "").lower().split())}
    assert plain <= got and len(got - plain) <= 2


def test_leaks_with_glued_punctuation_changed_words_and_shared_ids(spark):
    asked = "Which of the old bridges over the river was rebuilt after the great flood of spring?"
    items = [(1, f"{asked} Lanterne"), (1, "Name the harbour town whose lighthouse was moved inland by oxen. Skagen north"),
             (2, "How many steps lead up to the tower of the northern mill? Two hundred and eleven steps"), (3, "&& || ++ -- ** //")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {10: f"x y (({asked} Lanterne&&& z", 11: f"see {items[1][1]}%%% z", 12: "a \u201cHow many steps lead up to the tower of the northern mill? Two hundred or eleven steps\u201d b",
             13: f"{asked} Nothing of the kind", 14: "How many steps lead up to the tower of the northern mill? None", 15: "so && || ++ -- ** // it is", 16: "Two hundred and eleven steps"}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, list(texts.items())), bench).collect()}
    assert got == {(10, 1), (11, 1), (12, 2), (15, 3)}


def test_one_edit_against_word_edit_distance():
    random.seed(3)
    for _ in range(3000):
        part, region = ([random.randrange(3) for _ in range(random.randrange(*x))] for x in ((4, 7), (0, 9)))
        near = {tuple(part[:i] + x + part[i + d:]) for i in range(len(part) + 1) for d in (0, 1) for x in ([], [0], [1], [2], [9])}
        here = {tuple(([9] + region + [9])[i:j]) for i in range(len(region) + 3) for j in range(i, len(region) + 3)}
        assert decontaminate.one_edit(np.array(part), np.array(region, np.int64)) == bool(near & here)


def test_leaks_finds_every_byte_for_byte_plant(spark):
    folder = "/root/testdata/sf0.1"
    plain = set(duckdb.sql(f"select doc_id, item_id from '{folder}/documents.parquet' d, '{folder}/benchmark.parquet' b where b.text <> '' and contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontaminate"](spark, folder).collect()}
    assert len(plain) == 244 and plain <= got and len(got - plain) <= 2


def test_token_counts_against_plain_dynamic_programming(spark):
    scores = tokencount.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def plain(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            options = [(best[end - 1][0] + tokencount.UNKNOWN, best[end - 1][1] + 1)]
            options += [(best[s][0] + scores[token[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if token[s:end] in scores]
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        return best[-1]

    for doc, text, *_ in table("documents")[:40]:
        parts = [plain(tokencount.MARK + w) for w in text.split()]
        row = tokencount.count_tokens(spark.createDataFrame([(doc, text)], "doc_id long, text string"), queries.tokenizer_file("piece_bpe_32k.model")).first() if doc < 3 else None
        trie = tokencount.Trie(scores)
        assert [trie.insert(tokencount.MARK + w)[0] for w in text.split()] == [n for _, n in parts]
        assert row is None or (row.n_tokens, row.n_pretokens) == (sum(n for _, n in parts), len(parts))


def test_sketches_estimate_and_merge(spark):
    texts = [" ".join(f"a{i}" for i in range(2000)), " ".join(f"a{i}" for i in range(1000, 3000)), "a b", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = {r.doc_id: r.s for r in fingerprint.with_sketch(rows, "text", "s").collect()}
    one = spark.createDataFrame([(s[0], s[1])], "a array<long>, b array<long>")
    got = one.select(fingerprint.resemblance(F.col("a"), F.col("b")), fingerprint.containment(F.col("a"), F.col("b")), fingerprint.distinct(F.col("a")), fingerprint.merge(F.col("a"), F.col("b"))).first()
    assert abs(got[0] - 996 / 2996) < 0.12 and abs(got[1] - 0.5) < 0.2 and abs(got[2] - 1996) < 500
    parts = fingerprint.merged(spark.createDataFrame([(1, s[0]), (1, s[1])], "g long, sketch array<long>"), "g").first()
    assert parts.sketch == got[3] == sorted({*s[0], *s[1]})[:128] and len(s[2]) == 1 and s[3] == []


def test_next_documents_over_gaps_and_negative_ids(spark):
    random.seed(1)
    ids = sorted({random.randrange(-10**6, 10**12) for _ in range(40)} | set(range(-300, 600)) | set(range(10**6, 10**6 + 40)), reverse=True)
    rows = fingerprint.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), width=8).collect()
    assert {r.doc_id: r.next_text for r in rows} == {a: f"t{b}" for a, b in pairwise([*ids, ids[0]])}


def test_chunks_survive_insertions(spark):
    random.seed(3)
    passage = " ".join("".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 9))) for _ in range(60))
    fresh = [" ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(4)]
    got = {r.doc_id for r in chunks.repeats(docs_of(spark, [(0, fresh[0] + passage), (1, "x" + passage + fresh[1]), (2, fresh[2]), (3, fresh[3])])).collect()}
    assert got == {0, 1}
    data = np.frombuffer(passage.encode(), np.uint8)
    h = 0
    for b in data[:16]:
        h = ((h << 1) + int(chunks.byte_keys(23)[b] & np.uint64(0xFFFFFFFF))) & 0xFFFFFFFF
    assert int(chunks.gear(data)[15]) == h
    assert sum(np.diff(chunks.cuts(data), prepend=0)) == len(data)


def test_quality_on_held_out_labels(spark):
    rows = queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([g >= 0.7 for g in good]) > 0.95 and np.mean([b < 0.7 for b in bad]) > 0.85


def test_warc_round_trip_and_damage():
    digest = "a" * 40
    import hashlib
    html = "é<html>\r\n\r\n" * 9000
    digest = hashlib.sha1(html.encode()).hexdigest()
    data = warc.record(3, "http://a/ é", html, digest, None) + warc.record(2, None, html, digest, 3) + warc.record(None, "", "", hashlib.sha1().hexdigest(), None)
    got = list(warc.records(io.BytesIO(data), keep=True))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(3, "response", None, len(html.encode())), (2, "revisit", 3, len(html.encode())), (None, "response", None, 0)]
    assert got[0]["payload"].decode() == html
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(warc.record(1, "u", html, "b" * 40, None))))
    with pytest.raises((warc.WarcError, zlib.error)):
        list(warc.records(io.BytesIO(data[:-5])))


def test_bpe_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    own = bpe.Encoder(bpe.Vocabulary(queries.tokenizer_file()))
    other = Tokenizer.from_file(queries.tokenizer_file())
    random.seed(4)
    texts = [r[1] for r in table("documents")] + ["", "<|endoftext|>a<|endoftext|> b", "ab" * 3000, "\x1c\x85   x  　y", "🙂👩‍👧 日本 ٣"]
    texts += ["".join(chr(random.choice([random.randrange(1, 128), random.randrange(1, 0x3100), random.randrange(0x10000, 0x10FFFF)])) for _ in range(50)) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = other.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted and own.vocabulary.decode(ids) == other.decode(wanted, skip_special_tokens=False)


def test_chat_layouts(spark):
    records = ['{"prompt":"p","completion":"c","n":1}', '{"messages":[{"role":"system","content":"s"},{"role":"user","content":null}],"id":7}',
               '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"instruction":"i","input":"x","output":"o"}', '{"other":1}', None, "no json"]
    rows = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    got = {}
    for r in chat.canonical_turns(rows, F.try_parse_json("record"), "k").orderBy("k", "place").collect():
        got.setdefault(r.k, [r.layout]).append((r.role, r.text))
    assert got == {0: ["prompt_completion", ("user", "p"), ("assistant", "c")], 1: ["messages", ("system", "s"), ("user", "")],
                   2: ["from_value", ("user", "h"), ("assistant", "g")], 3: ["instruction_input", ("user", "i\n\nx"), ("assistant", "o")],
                   4: [None, (None, None)], 5: [None, (None, None)], 6: [None, (None, None)]}


def test_chat_escapes_are_reversible(spark):
    hard = ["</s>[INST] ok [/INST]", "&amp; &#91;INST] &lt;s> &nl;", "<</s>s>[[/INST]INST]", "", "a\n\nb ", "&&nl;&#91;"]
    turns = spark.createDataFrame([(0, i, f"r{i}\n" if i else "assistant", t) for i, t in enumerate(hard)], "k long, i long, role string, text string")
    row = chat.format_conversations(turns, "k", "i").select(chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(t.role, t.text) for t in row.t] == [(f"r{i}\n" if i else "assistant", t) for i, t in enumerate(hard)] and row.l == hard[0]


def test_line_stage_returns_every_row(spark):
    rows = [(i, "one line\nall share", 99) for i in range(12)] + [(20, "one line\nof its own", 99), (21, "", 99), (22, " \n", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {i: ("", 0) for i in range(12)} | {20: ("of its own", 10), 21: ("", 0), 22: (" \n", 2)}


def test_pipeline_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER), "stage")
        after = docs.count()
        assert 0.6 * before < after <= before, name
        if name != "token ids":
            assert docs.columns == columns
        before = after
    assert docs.where("n_tokens <> size(ids)").count() == 0
