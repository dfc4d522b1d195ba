from __future__ import annotations

import numpy as np
import pytest

from rwspark.llm import components as C
from rwspark.llm import jaccard as J


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    at = list(range(len(texts)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_texts(seed, n=120):
    """Groups of copies with a few words changed, added or dropped, of all sizes, and passages that many share."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 30))
    out = []
    while len(out) < n:
        base = list(rng.choice(words, rng.choice([3, 8, 12, 20, 40, 90, 200, 500]))) + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for _ in range(rng.integers(0, 1 + len(copy) // 25 + 1)):
                k = rng.integers(0, len(copy))
                copy[k : k + rng.integers(0, 2)] = [str(rng.choice(words))] * int(rng.integers(0, 2))
                copy = copy or ["w"]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (5, 80, 2), (2, 70, 3)])
def test_classes_are_the_brute_force_ones(docs, size, percent, seed):
    texts = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs(texts), size, percent).collect()}
    assert got == brute(texts, size, percent)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(2, 900))
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        t = s.copy()
        drop = int(rng.integers(0, 1 + len(s) * (100 - percent) // 100))
        t = np.unique(np.concatenate((rng.permutation(t)[drop:], rng.integers(0, 2**64, int(rng.integers(0, drop + 1)), dtype=np.uint64))))
        shared = len(np.intersect1d(s, t))
        if 100 * shared >= percent * (len(s) + len(t) - shared) and not np.array_equal(s, t):
            assert np.intersect1d(J.signatures(s, percent), J.signatures(t, percent)).size


@pytest.mark.parametrize("percent", [50, 67, 70, 80, 85, 90, 95])
def test_small_sets_at_the_threshold_share_a_signature(percent):
    """All sizes from 1 to 40, with as few elements shared as a link allows."""
    rng = np.random.default_rng(percent)
    for n in range(1, 41):
        for m in range(n, 41):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared > n or shared == n == m:
                continue
            assert 100 * shared >= percent * (n + m - shared)
            x = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
            s, t = np.unique(x[:n]), np.unique(x[n - shared :])
            assert np.intersect1d(J.signatures(s, percent), J.signatures(t, percent)).size, (n, m)


@pytest.mark.parametrize("size, percent, words", [(4, 85, 9), (5, 80, 8)])
def test_one_word_more_in_a_short_text(docs, size, percent, words):
    text = " ".join(f"w{i}" for i in range(words))
    texts = [text, f"{text} x", f"y {text}", "other words " + text[:5]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs(texts), size, percent).collect()}
    assert got == brute(texts, size, percent) and got[1][1] == got[2][1] == 0


def test_one_large_group(docs):
    """Copies and near copies of one text: no pairs within the group but those with its representative."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 200 + [" ".join(base[:30] + [f"x{i}"] + base[31:]) for i in range(100)]
    got = {r.component_id for r in J.classes(docs(texts), 4, 85).collect()}
    assert got == {0}


def test_edges(docs, edge_texts):
    rows = docs(edge_texts, extra=True)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(rows, 4, 85).collect()}
    assert got == brute(edge_texts, 4, 85)
    assert J.classes(docs([])).count() == 0
    got = J.classes(docs([(None, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s")]), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 3), (200, 200)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        t = np.unique(np.concatenate((s[int(rng.integers(0, n // 3 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 3 + 1)), dtype=np.uint64))))
        x, y = J.folded([J.sketch(s), J.sketch(t)])
        assert J.differing(x, y) <= len(np.setxor1d(s, t))


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("forest", [False, True])
def test_neighbours_in_blocks(spark, block, forest):
    """All near pairs of a signature across components, or as many as join them, however its rows are dealt."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[i % 5 :], rng.integers(0, 2**64, i % 3, dtype=np.uint64)))) for i in range(20)]
    groups = spark.createDataFrame([(i, 0 if i < 6 else i // 2) for i in range(20)], "node long, component long")
    rows = spark.createDataFrame([(sig, i) for sig in (1, 2) for i in range(20)], "sig long, node long")
    marks = spark.createDataFrame([(i, len(s), J.sketch(s)) for i, s in enumerate(sets)], "node long, n long, sketch binary")
    split = J.still_split(rows, groups, spark.createDataFrame([(0, 1)], "a long, b long")).drop("hub", "apart")
    found = [(r.a, r.b) for r in J.neighbours(split.join(marks, "node"), 85, 0 if forest else None, block).collect()]
    undone = {b for a, b in found if a is None}
    found = [x for x in found if x[0] is not None]
    group = lambda i: 0 if i < 6 else i // 2
    linked = {(i, j) for j in range(20) for i in range(j) if group(i) != group(j) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert linked and len(found) == len(set(found)) and all(group(a) != group(b) for a, b in found)
    assert bool(undone) == forest
    if forest:
        at = {i: group(i) for i in range(20)}
        for a, b in found:
            at = {k: at[a] if v == at[b] else v for k, v in at.items()}
        assert all(at[a] == at[b] for a, b in linked)
        assert block == 3 or len(found) <= 2 * 7
    else:
        assert linked <= set(found)


def test_sets_that_share_a_number_begin_again(docs, monkeypatch):
    number = J._number
    monkeypatch.setattr(J, "_number", lambda s, seed: (number(s, seed)[0] % 3 if seed == 0 else number(s, seed)[0], number(s, seed)[1]))
    texts = near_texts(5, 20)
    found, sets, seed = J.numbered(docs(texts).selectExpr("doc_id AS id", "cast(text AS binary) AS text"), 4)
    assert seed == 1 and found.count() == 20


def test_rows_that_share_an_id(docs):
    """One document: what either text links to is in its component."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = J.classes(docs([(1, a, "en", "s"), (4, a, "en", "s"), (4, b, "en", "s"), (9, b, "en", "s"), (7, "x y", "en", "s")]), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (4, 1), (4, 1), (7, 7), (9, 1)]


@pytest.mark.parametrize("percent", [85])
def test_many_copies_of_copies(docs, percent):
    """A chain of edits, of which each is near its neighbours only, in a table with far ones that share most signatures."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        words = list(words)
        for k in rng.integers(0, 300, 3):
            words[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs(texts), 4, percent).collect()}
    assert got == brute(texts, 4, percent)
