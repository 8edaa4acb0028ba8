"""SimHash, prefix trie and repair of conversations against plain versions, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetsense.llm import prefixtrie, repair, simhash

TURNS = "conv_id long, turn long, role string, text string, row long, place long, fault int, path binary, n_convs long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, b"x", 4) for r in rows], TURNS)


def plain_simhash(text, n=3):
    words = (text or "").encode().translate(simhash.LOWER).split()
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_of(values, most=3):
    """Smallest position reachable, by comparing all pairs."""
    root = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= most and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_fingerprints_against_plain_votes(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    random.seed(1)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "ÄÖ\xa0ß x\x0by\x0cz", "x" * 500 + " y z"]
    texts += [" \n".join(random.choice(["aa", "b", "Cc", "ddddddddddddddddddddddddddddddddddddd"]) for _ in range(random.randrange(200))) for _ in range(30)]
    for t in texts:
        assert simhash.simhash(t.encode(), 3) == plain_simhash(t)


@pytest.mark.parametrize("full", [3, 20_000])
def test_links_by_anchors_against_all_pairs(spark, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL", full)      # 3: anchors are split into parts
    monkeypatch.setattr(simhash, "GATHER", 500)
    rng = random.Random(full)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):        # distances of 1 to 5 from each other, in all blocks
        x = rng.choice(values)
        for k in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << k
        values.append(x)
    hub = rng.getrandbits(64)   # many in one ball
    values += [hub ^ (1 << a | 1 << b) for a in range(0, 40) for b in (a, a + 7)]
    values = list(dict.fromkeys(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long"), 3).collect()
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))
    for r in got:
        assert (values[at[r.a]] ^ values[at[r.b]]).bit_count() <= 64
        x, y = sorted((root[at[r.a]], root[at[r.b]]))
        root = [x if q == y else q for q in root]
    assert root == components_of(values)


def test_every_fingerprint_meets_all_within_three_bits():
    rng = random.Random(9)
    block, parts = simhash.Block(3), np.ones(1 << 24, np.uint8)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randrange(4)):
            y ^= 1 << k
        home = [int(c[0]) for c, _, h in simhash.entries(np.array([x], np.uint64), block, parts, 3) if h.any()]
        reach = np.concatenate([c for c, _, h in simhash.entries(np.array([y], np.uint64), block, parts, 3) if not h.any()])
        assert len(home) == 1 and home[0] in reach and len(set(reach.tolist())) == len(reach)


def test_simhash_odd_rows_ties_and_copies(spark):
    rows = [(None, None), (None, "a b c d"), (1, None), (2, ""), (3, " \n"), (4, "a b c d"), (4, "a b c d"), (5, "A  b C\nd"), (6, "word " * 40_000), (6, "y" * 70_000), (-7, "other words stand here")]
    docs = spark.createDataFrame([(i, t, 0, "z", 1) for i, t in rows], "doc_id long, text string, bits long, head string, least long")
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [plain_simhash(t) for _, t in rows]
    assert prints[0] == 0
    root = components_of(prints)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    assert got == sorted((repr(rows[i][0]), f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    alone = simhash.near_duplicates(docs.where("doc_id is null")).collect()
    assert len(alone) == 2 and all(r.component_id is None for r in alone)


def plain_trie(convs):
    """conv -> list of turns to node rows."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for q in nodes:
        if q:
            kids.setdefault(q[:-1], []).append(q)

    def under(q):
        own = (len(nodes[q]) - 1) * len(q[-1][1].encode()) if q else 0
        below = [under(k) for k in kids.get(q, [])]
        return (sum(b[0] for b in below) if below else 1), own + sum(b[1] for b in below)

    out = []
    for q, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if tuple(convs[c]) == q)))
        leaves, saved = under(q)
        out.append((min(members), len(q), min(nodes[q[:-1]]) if q else None, len(members), len(kids.get(q, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_trie_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN", 4)       # ids that end at a node come in many runs
    rng = random.Random(3)
    rows, convs = [], {}
    for c in [*range(60), -5, 10**12]:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é"])) for _ in range(rng.choice([1, 2, 3, 12]))]
        if c % 3 == 0:
            turns = [("user", "same"), ("assistant", "answer")]
        rows += [(c, None if i == 0 and c % 2 else i, r, t) for i, (r, t) in enumerate(turns)]
        convs[c] = [(r or "", t or "") for r, t in turns]
    rows += [(None, 0, "user", "x"), (70, 0, "user", "long " * 200_000), (71, 4, "user", "a"), (71, 4, "user", "a")]
    convs |= {70: [("user", "long " * 200_000)], 71: [("user", "a")] * 2}
    for c, n, last in ((100, 60, "x"), (101, 60, "y"), (102, 40, ""), (103, 45, ""), (104, 60, "x"), (105, 17, "z"), (106, 90, "own"), (107, 16, "")):
        deep = [(("user", "assistant")[i % 2], f"{'own' if c == 106 else 'deep'} {i}") for i in range(n - 1)] + [("user", last or f"deep {n - 1}")]
        rows += [(c, i, *t) for i, t in enumerate(deep)]
        convs[c] = deep
    rng.shuffle(rows)
    got = prefixtrie.prefix_trie(turns_of(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(convs)
    assert prefixtrie.prefix_trie(turns_of(spark, [])).collect() == []
    assert prefixtrie.prefix_trie(turns_of(spark, [(None, 1, "user", "x")])).collect() == []


def test_spliced_conversations(spark):
    rows = [(c, i, "user", f"{c}.{i}") for c in (0, 1, 3, 5, 12, 13, -4, -5, 17) for i in range(12)]
    got = {r.conv_id: len(r.turns) for r in prefixtrie.spliced(prefixtrie.turn_lists(turns_of(spark, rows))).collect()}
    ids = {r[0] for r in rows}
    wanted = {}
    for c in ids:
        h, base = zlib.crc32(str(c).encode()) % 9, int(c / 5) * 5
        wanted[c] = 12 - h + (h if base in ids else 0)
    assert got == wanted


def plain_repair(rows):
    """rows: (initial, fault) in order; (cost, audit) by whole strings, smallest cost and then least letters."""
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                t = repair.NEXT[s]
                best[t] = min(best.get(t, (10**9, "")), (c + 5, a + "I"))
        return best

    for x, fault in rows:
        new = {}
        for s, (c, a) in inserts(best).items():
            moves = [(s, c + 2, "D")]
            if fault in (0, 3):
                more = 5 * (fault == 3)
                moves.append((repair.NEXT[s], c + 1 + more, "R"))
                if s in repair.KEEPS.get(x, {}):
                    moves.append((repair.KEEPS[x][s], c + more, "K"))
            for t, price, letter in moves:
                new[t] = min(new.get(t, (10**9, "")), (price, a + letter))
        best = new
    inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_survivors_against_whole_strings():
    rng = random.Random(2)
    for _ in range(4000):
        pool = rng.choice(["ua", "uas", "uasx", "x", "s", "u"])
        rows = [(rng.choice(pool), rng.choices((0, 1, 2, 3), (6, 1, 1, rng.choice([0, 2])))[0]) for _ in range(rng.randrange(14))]
        audit = []
        s = repair.Survivors(audit.append)
        for r in rows:
            s.consume(*r)
        assert (s.finish(), "".join(audit)) == plain_repair(rows)


def test_edits_come_early_and_memory_stays_bounded():
    audit = []
    s = repair.Survivors(audit.append)
    rng = random.Random(4)
    for i in range(20_000):
        s.consume("ua"[i % 2] if rng.random() < 0.9 else rng.choice("uasx"), 0)
        assert i - len(audit) < 200
    assert len(s.parent) < 500
    for _ in range(20_000):         # undecided to the end: two alignments cost the same, their fork is not searched again
        s.consume("x", 0)
    s.finish()
    assert sum(x != "I" for x in audit) == 40_000


def test_repair_report_and_turns_on_odd_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "and then"), (1, 6, "assistant", "\t\n"),
            (2, None, "assistant", "No!"), (2, None, None, None), (None, 3, "tool", "x." * 200_000), (None, 3, "user", "Why?"), (3, 2, "system", " "), (4, -3, "", "a.")]
    got = {r.conv_id: r for r in repair.report(turns_of(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 1, 1, 1, 1, 6, "KKDDD")
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Yes.").hexdigest()
    assert (got[2].gaps, got[2].blank, got[3].audit, got[3].cost, got[4].audit, got[None].audit) == (0, 1, "D", 2, "D", "RR")
    turns = repair.repaired(turns_of(spark, rows)).orderBy("conv_id", "place").collect()
    assert [(t.edit, t.role, t.text) for t in turns if t.conv_id == 1] == [("K", "user", "Hello."), ("K", "assistant", "Yes."), ("D", None, None), ("D", None, None), ("D", None, None)]
    assert [t.role for t in turns if t.conv_id is None] == ["user", "assistant"]
    assert repair.report(turns_of(spark, [])).collect() == [] and repair.repaired(turns_of(spark, [])).collect() == []
    gone = repair.report(turns_of(spark, rows[:1]).withColumn("here", F.lit(False)), F.col("here")).first()
    assert (gone.n_rows, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, "", hashlib.sha256().hexdigest())
