"""Language identification and token counts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rwspark.llm import langid as L
from rwspark.llm import token_counts as C


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 60")
    train, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    pages = rest.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"), "lang")
    model = L.fitted(train, 300)
    got = {r.page_id: r.lang for r in L.identified(L.page_evidence(pages, model), model[0]).collect()}
    want = {r.page_id: r.lang for r in pages.select("page_id", "lang").collect()}
    assert sum(got[i] == lang for i, lang in want.items()) / len(want) > 0.95
    got = {r.doc_id: r.lang for r in L.identified(L.document_evidence(rest, model), model[0]).collect()}
    assert sum(got[i] == lang for i, lang in want.items()) / len(want) > 0.95


@pytest.fixture(scope="module")
def model():
    grams = {g: [-1.0, -5.0] for g in L.trigrams("hello")} | {g: [-5.0, -1.0] for g in L.trigrams("bonjour")}
    return ["en", "fr"], grams, [-6.0, -6.0]


def test_evidence_is_fused(spark, model):
    """A page without text is judged by its host, another by its text against a wrong declaration."""
    rows = [(i, f"http://a.example.fr/{i}", "<html lang=fr><p>" + "bonjour " * 20) for i in range(30)] + [(50 + i, f"http://b.example.com/{i}", "<html lang=en><p>" + "hello " * 20) for i in range(30)]
    rows += [(100, "http://a.example.fr/x", ""), (101, "http://b.example.com/x", None), (102, "http://a.example.fr/y", "<html lang=fr><p>" + "hello " * 50), (103, None, None)]
    got = {r.page_id: r for r in L.identified(L.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"), model), model[0]).collect()}
    assert len(got) == len(rows)
    assert got[100].lang == "fr" and got[101].lang == "en" and got[0].lang == "fr" and got[50].lang == "en"
    assert got[102].text_lang == "en" and all(0 < r.confidence <= 1 for r in got.values())


def test_no_pages_and_no_labels(spark, docs, model):
    assert L.identified(L.page_evidence(spark.createDataFrame([], "page_id long, url string, html string"), model), model[0]).count() == 0
    assert L.identified(L.document_evidence(docs([]), model), model[0]).count() == 0
    odd = L.identified(L.document_evidence(docs([(None, None, None, None), (1, "", "en", "s"), (1, "hello", "en", "s")], extra=True), model), model[0]).collect()
    assert len(odd) == 3 and all(r.lang for r in odd)
    with pytest.raises(ValueError):
        L.fitted(docs([(1, "text", None, "s"), (2, None, "en", "s")]))


def brute_count(word, score, byte, longest):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        extra = len(word[end - 1].encode())
        options = [(best[end - 1][0] + extra * byte, -(best[end - 1][1] + extra))]
        options += [(best[s][0] + score[word[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - longest), end) if word[s:end] in score]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_counts_are_those_of_each_word_alone(docs, spark, small, edge_texts):
    from rwspark.llm.queries import pieces_path

    model = C.Unigram.load(pieces_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()} | {10_000 + i: t for i, t in enumerate(edge_texts) if t != edge_texts[9]}
    rows = docs([(i, t, "en", "s") for i, t in texts.items()], extra=True)
    for r in C.counted(rows, pieces_path).collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(brute_count(C.MARK + w, model.score, model.byte, model.longest) for w in words)
    assert C.counted(docs([]), pieces_path).count() == 0


def test_shared_prefixes_are_scored_once():
    model = C.Unigram([C.MARK, "a", "b", "ab", "abc"])
    assert model.walk(sorted([C.MARK + "ab", C.MARK + "abc", C.MARK + "abd", C.MARK + "b"])) == [2, 2, 3, 2]
    assert model.nodes == 6  # of 13 characters
    assert math.isclose(sum(math.exp(s) for s in model.score.values()), 1.0)
