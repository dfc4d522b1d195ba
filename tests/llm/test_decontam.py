from __future__ import annotations

import re

import numpy as np

from rwspark.llm import decontam as D


def brute(text, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            p = w[i : i + size]
            for s in range(len(own) - len(p) + 1):
                if own[s : s + len(p)] == p:
                    hit |= set(range(s, s + len(p)))
                    found.add(name)
    return len(own), len(hit), sorted(found)


def test_search_is_brute_force(spark, docs, edge_texts):
    rng = np.random.default_rng(2)
    words = ["a", "b", "Ab", "É", "x1", "漢", "the"]
    items = [(str(i), " ".join(rng.choice(words, n))) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 20, 20, 30])] + [("11", None), ("12", "!!"), ("10", "dup " * 14)]
    texts = edge_texts[:5] + edge_texts[6:9] + [" ".join(rng.choice(words, 60)) + " " + items[k % 11][1] + "; " + " ".join(rng.choice(words, 5)) for k in range(40)] + ["dup " * 50]
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    for most in (32 << 20, 50):  # one pass, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.occurrences(docs(texts, extra=True), bench, most_bytes=most).collect()}
        assert got == {i: brute(t, items) for i, t in enumerate(texts)}


def test_skips_are_long():
    """The shift table skips most positions of a text without a pattern."""
    looked = 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal looked
            looked += isinstance(i, int)
            return list.__getitem__(self, i)

    table = D.WuManber(D.windows([("1", b" ".join(b"p%d" % i for i in range(20)))]))
    assert table.search(Counted(b"w%d" % i for i in range(1200))) == []
    assert looked <= 2 * 1200 / 12 + 2


def test_verdict_and_edges(spark, docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    texts = ["one two three" + " w" * 57, "one two three" + " w" * 58, None, ""]
    got = D.judged(D.occurrences(docs(texts), bench)).orderBy("doc_id").collect()
    assert [r.contaminated for r in got] == [True, False, False, False]
    assert D.occurrences(docs([]), bench).count() == 0
    none = D.judged(D.occurrences(docs(texts), bench.limit(0))).collect()
    assert len(none) == 4 and not any(r.contaminated for r in none)


def test_items_without_an_id(spark, docs):
    bench = spark.createDataFrame([(None, "beta gamma"), ("x", "delta"), (None, "beta gamma")], "item_id string, text string")
    for most in (32 << 20, 8):
        (r,) = D.occurrences(docs(["alpha beta gamma delta"]), bench, most_bytes=most).collect()
        assert (r.n_words, r.n_hit, r["items"]) == (4, 3, ["x"])


def test_any_column_is_kept(spark, docs):
    rows = docs(["one two"]).selectExpr("doc_id AS items", "text", "lang AS Spans", "source AS _searched", "n_chars AS kept_items")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    (r,) = D.occurrences(rows, bench, id_col="items", keep=("Spans", "_searched", "kept_items")).collect()
    assert (r.kept_items, r.kept_Spans, r.kept__searched, r.kept_kept_items, r["items"], r.spans) == (0, "en", "s", 7, ["1"], [0, 2])


def test_very_long_text(spark, docs):
    bench = spark.createDataFrame([(1, "needle " * 13)], "item_id long, text string")
    (r,) = D.occurrences(docs(["hay " * 200_000 + "needle " * 13 + "stack" * 50_000]), bench).collect()
    assert (r.n_words, r.n_hit, r["items"]) == (200_014, 13, ["1"])
