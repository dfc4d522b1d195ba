from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from rwspark.llm import periodic as P
from rwspark.llm import queries


def brute(ids, least=12):
    """All runs, by each period's own stretches of equal words."""
    n, found = len(ids), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(ids[x] == ids[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def word_lists(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        letters, words = r.choice([1, 2, 3, 5, 60]), []
        while len(words) < r.choice([3, 30, 150, 400]):
            unit = [r.randrange(letters) for _ in range(r.randrange(1, r.choice([4, 40, 120])))]
            words += (unit * 6)[: r.randrange(1, 5 * len(unit) + 1)]
            if r.random() < 0.2:
                words += words[-r.randrange(1, len(words) + 1) :]
        yield words[:450]


@pytest.mark.parametrize("least", [12, 2, 5, 21])
def test_runs_are_all_runs(least):
    for words in word_lists(least, 120):
        assert P.runs(tuple(words), least) == brute(words, least), words


def test_each_scale_and_boundary():
    for q in range(1, 140):
        for more in (0, 1, q // 2):
            for before in (0, 1, 3, 7):
                words = [10_000 + k for k in range(before)] + [k % q for k in range(max(12, 2 * q) + more)] + [20_000, 20_001]
                assert (before, max(12, 2 * q) + more, q) in P.runs(tuple(words))
    assert P.runs(tuple(k % 50 for k in range(99))) == [] == P.runs((1,) * 11)
    assert P.runs((1,) * 12) == [(0, 12, 1)] and P.runs(()) == [] == P.runs((5,))


def test_very_long_periodic_texts():
    assert P.runs((7,) * 100_000) == [(0, 100_000, 1)]
    long = tuple(range(30_001)) * 3
    assert P.runs(long) == [(0, 90_003, 30_001)]
    assert P.runs((1,) * 9_000 + (2,) + (1,) * 9_000 + (2,)) == [(0, 9_000, 1), (0, 18_002, 9_001), (9_001, 9_000, 1)]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *best, digest("".join(f"{a},{n},{q}\n" for a, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_matches_brute_force(spark, docs, tmp_path):
    r = random.Random(3)
    texts = [None, "", " \n ", "one", "a b " * 40, "ü 漢 字 \x0b" * 30, *(" ".join(map(str, w)) for w in word_lists(9, 60))]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts * 3)] + [(None, "x y " * 10, "en", "s"), (5, texts[5], None, None)] * 2
    r.shuffle(rows)
    docs(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).drop("n_words").collect()
    key = lambda x: str(tuple(x))
    assert sorted((tuple(x) for x in got), key=key) == sorted((expected(a, t) for a, t, _, _ in rows), key=key)
    assert sum(x.n_runs > 0 for x in got) > 30


def test_edges(spark, docs, edge_texts):
    got = {x.doc_id: x for x in P.detected(docs(edge_texts, extra=True), keep=("n", "lang", "_text", "spans")).collect()}
    assert len(got) == len(edge_texts) and got[0].runs == [] and got[0].collapsed == "" and got[0].n == "clash"
    assert [tuple(x) for x in got[5].runs] == [(0, 40_000, 1)] and got[5].collapsed == "word"
    assert P.detected(docs([])).count() == 0
    clash = P.detected(docs(["a b"]).withColumnRenamed("lang", "Runs").withColumnRenamed("source", "kept_runs"), keep=("Runs", "kept_runs", "n_chars"))
    assert clash.columns == ["doc_id", "kept_Runs", "kept_kept_runs", "n_chars", "n_words", "runs", "collapsed"] and clash.first().kept_Runs == "en"
