"""Links of the Jaccard join against all pairs."""

import random

import pytest

from fleetsense.llm import jaccard

SCHEMA = "doc_id long, text string"


def shingle_set(text, n):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain(texts, n, percent):
    """doc_id -> n_shingles, component, class and number of links."""
    sets = {i: shingle_set(t, n) for i, t in texts}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            more = linked[todo.pop()] - seen
            seen |= more
            todo += more
        out[i] = (len(sets[i]), min(seen), min([i, *(j for j in linked[i] if sets[j] == sets[i])]), len(linked[i]))
    return out, sets


def corpus(seed, rows):
    random.seed(seed)
    base = [[f"w{random.randrange(300)}" for _ in range(random.randrange(3, 60))] for _ in range(6)]
    texts = [(900, ""), (901, None), (902, " \t"), (903, "one"), (904, "ONE "), (905, "x" * 70_000), (906, "word " * 20_000)]
    for i in range(rows):
        w = list(random.choice(base[:2] if i % 3 else base))       # two groups hold most rows
        for _ in range(random.randrange(3)):
            w[random.randrange(len(w))] = f"n{random.randrange(40)}"
        texts.append((i, " ".join(w)))
    return texts


@pytest.mark.parametrize(("block", "n", "percent"), [(1_000, 4, 85), (3, 4, 85), (2, 5, 80)])
def test_links_against_all_pairs(spark, monkeypatch, block, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CELL", block * 50)
    texts = corpus(block, 150)
    wanted, sets = plain(texts, n, percent)
    d = spark.createDataFrame(texts, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.class_id, r.n_links) for r in jaccard.with_links(d, n, percent).collect()}
    assert got == wanted and max(x[3] for x in wanted.values()) > 10
    links, member, _ = jaccard.join(d, n, percent)
    heads = {r.head for r in member.collect() if r.n}
    pairs = {(r.a, r.b): (r.n_a, r.n_b, r.overlap) for r in links.collect()}
    assert links.count() == len(pairs)
    assert pairs == {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in heads for b in heads
                     if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_links_of_odd_rows(spark):
    words = "one two three four five six seven"
    rows = [(1, words), (1, words), (2, words.upper()), (None, words), (None, None), (3, None), (4, words + " a b c d e f g h i"), (4, words)]
    d = spark.createDataFrame([(i, t, 0, 1.0, "x") for i, t in rows], SCHEMA + ", head long, n_links double, rank string")
    got = {r.doc_id: tuple(r)[1:] for r in jaccard.with_links(d).collect()}
    # a shared id is one document with the text of fewest shingles; null ids are one row outside all links
    assert got == {1: (3, 1, 1, 2), 2: (3, 1, 1, 2), 4: (3, 1, 1, 2), 3: (0, 3, 3, 0), None: (0, None, None, None)}
    assert jaccard.with_links(d.limit(0)).collect() == []
