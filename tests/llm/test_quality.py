from __future__ import annotations

import re
from collections import Counter

import numpy as np

from rwspark.llm import quality as Q
from rwspark.llm.common import written


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    count = Counter(grams)
    within = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(within)


def test_counts(spark, docs, edge_texts, small):
    rng = np.random.default_rng(3)
    texts = edge_texts + [" ".join(rng.choice(["a", "b", "c", "#d", "e|", "\n"], 300)) for _ in range(30)] + ["a b c a b c", "a a a", "a a a a", "a b c d a b c", "a\x0bb\x0cc\rd", "    x"]
    rows = Q.statistics(docs(texts, extra=True), ("doc_id",)).collect()
    assert {r.doc_id: tuple(r[c] for c in Q.NAMES) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    real = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    assert all(tuple(r[c] for c in Q.NAMES) == brute(texts[r.doc_id]) for r in Q.statistics(real, ("doc_id",)).collect())


def chi2(x):
    """Distribution function of 4 degrees of freedom."""
    return 1 - np.exp(-x / 2) * (1 + x / 2)


def chi2_at(q):
    grid = np.linspace(0, 60, 6_000_001)
    return np.interp(q, chi2(grid), grid)


def brute_mcd(x, share, steps, floors):
    """The same estimate with numpy: three starts, whole bins of distance in each step, the least determinant, one reweighting."""

    def quantile(col, q):
        b, n = np.unique(np.floor(col * 256), return_counts=True)
        before = np.cumsum(n) - n
        return (b[before < q * n.sum()].max() + 0.5) / 256

    f2 = np.diag(np.array(floors) ** 2)
    dist = lambda m, c: ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
    estimate = lambda y, k: (y.mean(0), np.cov(y.T, bias=True) * k + f2)
    spread = [((quantile(v, 0.75) - quantile(v, 0.25)) / 1.349) ** 2 for v in x.T]
    near = np.array([quantile(c, 0.5) for c in x.T]), np.diag(spread) + f2
    starts = [near, estimate(x, 1.0), estimate(x[dist(*near) <= chi2_at(0.5)], 1.0)]
    top = chi2_at(share)
    scale = share / (1 - np.exp(-top / 2) * (1 + top / 2 + top**2 / 8))  # 6 degrees of freedom
    ends = []
    for now in starts:
        det = np.inf
        for _ in range(steps):
            b = np.floor(np.log1p(dist(*now)) * 64)
            u, n = np.unique(b, return_counts=True)
            new = estimate(x[b <= u[(np.cumsum(n) - n) < share * len(x)].max()], scale)
            if np.linalg.det(new[1]) >= det * (1 - 1e-9):
                break
            now, det = new, np.linalg.det(new[1])
        ends.append((det, now))
    m, c = min(ends, key=lambda e: e[0])[1]
    m, c = estimate(x[dist(m, c) <= chi2_at(0.975)], 1.0)
    return np.sqrt(dist(m, c))


def test_estimate_is_the_brute_force_one(spark):
    """In groups of language and source, of a language's small sources, and of all that is left."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = written(Q.statistics(docs, ("doc_id", "lang", "source")), "test")
    frame = stats.filter("not base_failed").toPandas()
    share = lambda a, b: np.sqrt(frame[a] / np.maximum(frame[b], 1))
    x = np.stack((np.log(frame.word_chars / frame.n_words), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")), 1)
    lang, source = frame.lang.fillna("?"), frame.source.fillna("?")
    fine = Counter(zip(lang, source))
    for least in (10**9, 30, 12):
        rest = Counter()
        for (a, _), n in fine.items():
            rest[a] += n if n < least else 0
        name = lambda a, s: (a, s) if fine[a, s] >= least else (a, "*") if rest[a] >= least else "*"
        names = [name(a, s) for a, s in zip(lang, source)]
        want = np.zeros(len(x))
        for g in set(names):
            at = np.array([n == g for n in names])
            want[at] = brute_mcd(x[at], 0.75, 20, Q.FLOORS)
        got = {r.doc_id: r.distance for r in Q.judged(stats, least=least).collect() if r.distance is not None}
        assert len(set(names)) > 3 or least == 10**9
        assert np.allclose([got[i] for i in frame.doc_id], want, rtol=1e-6), least


def test_junk_goes_and_clean_stays(docs):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(3000)]
    clean = [" ".join(rng.choice(vocabulary, rng.integers(60, 2000))) for _ in range(150)]
    junk = [" ".join(w + "$$$" for w in rng.choice(vocabulary, 200)) for _ in range(30)]
    got = {r.doc_id: r.kept for r in Q.rules(docs(clean + junk)).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 180))


def test_each_statistic_can_reject(docs):
    """Repeated lines or windows alone, below the base rule's bound; a table in which few lines come twice stays."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(3000)]
    some = lambda n: list(rng.choice(vocabulary, n))
    clean = ["\n".join(" ".join(some(8)) for _ in range(40)) for _ in range(150)]
    heading = [" ".join(some(2)) for _ in range(4)]
    table = ["\n".join([*heading, *(" ".join(some(8)) for _ in range(40)), heading[0]]) for _ in range(5)]
    lines = ["\n".join(["next"] * 40 + [" ".join(some(9)) for _ in range(40)]) for _ in range(5)]
    words = [" ".join(some(60) + (said := some(25)) + some(30) + said) for _ in range(5)]
    got = {r.doc_id: r for r in Q.rules(docs(clean + table + lines + words)).collect()}
    assert all(got[i].kept for i in range(155)) and not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(155, 165))


def test_edges(docs, edge_texts):
    got = Q.rules(docs([(i if i else None, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(edge_texts)], extra=True)).collect()
    assert len(got) == len(edge_texts) and not any(r.kept for r in got)  # all are short or repeat themselves
    assert Q.rules(docs([])).count() == 0
    one = " ".join(f"w{i}" for i in range(60))
    assert [r.kept for r in Q.rules(docs([one] * 3)).collect()] == [True] * 3


def test_any_column_is_kept(spark, docs):
    rows = docs(["some words " * 40, None]).selectExpr("*", "'a' AS g", "'b' AS x0", "'c' AS _words", "'d' AS kept", "'e' AS count", "'f' AS d2", "'g' AS _l")
    got = Q.rules(rows, keep=("doc_id", "g", "x0", "_words", "kept", "count", "d2", "_l", "lang")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.g, r.x0, r._words, r.kept_kept, r["count"], r.d2, r._l, r.lang) for r in got] == [(k, "a", "b", "c", "d", "e", "f", "g", "en") for k in (0, 1)]
