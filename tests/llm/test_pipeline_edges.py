"""Nulls, empty texts, repeated rows, ties, clashing columns and empty tables through every stage of the pipeline."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P

WORDS = "river stone light garden window music letter forest winter morning table silver paper mountain candle market bridge harbour autumn village".split()


def text(seed, n=90):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    bench = [("b1", text("bench", 30)), (None, text("nameless", 20)), ("b2", None), ("b3", "")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


@pytest.fixture(scope="module")
def rows():
    r = [(k, text(k), "en", "web" if k % 3 else "books") for k in range(40)]
    r += [(40, None, "en", "web"), (41, "", "en", "web"), (42, " \n ", None, None), (43, "one", "en", None), (44, text(44), None, None)]
    r += [(50, text(1), "en", "web"), (51, text(1) + " end", "en", "web"), (52, text(2), "de", "books")]  # copies of 1 and 2
    r += [(5, text(5), "en", "web")] * 2 + [(None, text(60), "en", "web")] * 2  # repeated rows, and rows without an id
    r += [(61, text(61, 60) + " " + text("bench", 30), "en", "web"), (62, text(62, 60) + " " + text("nameless", 20), "en", "web"), (63, text(63, 30_000), "en", "books")]
    return r


def run(spark, stage, frame, folder):
    return P.written(stage(spark, P.written(frame, "edges"), folder), "edges").collect()


@pytest.fixture(scope="module")
def frame(docs, rows):
    return docs(rows, extra=True)


def test_quality_stage(spark, frame, folder):
    got = run(spark, P.quality_rules, frame, folder)
    ids = [r.doc_id for r in got]
    assert set(ids) >= {0, 1, 2, 44, 50, 51, 52, 61, 62, None} and not {40, 41, 42, 43} & set(ids)
    assert ids.count(5) == 3 and ids.count(None) == 2 and [r for r in got if r.doc_id == 44][0].source is None


def test_join_stage(spark, frame, folder):
    got = run(spark, P.ngram_jaccard, frame, folder)
    ids = [r.doc_id for r in got]
    assert not {50, 51, 52} & set(ids) and set(ids) >= {*range(45), 61, 62, 63} and ids.count(5) == 1 and ids.count(None) == 2


def test_decontamination_stage(spark, frame, folder):
    ids = [r.doc_id for r in run(spark, P.benchmark_decontamination, frame, folder)]
    assert not {61, 62} & set(ids) and set(ids) >= {*range(45), 50, 51, 52, 63} and ids.count(5) == 3


def test_mixing_stage(spark, frame, rows, folder):
    got = run(spark, P.mixing_to_weights, frame, folder)
    assert {r.doc_id for r in got} == {r[0] for r in rows} and len(got) >= len(rows)


def test_token_stage(spark, frame, rows, folder):
    got = sorted(run(spark, P.token_output, frame, folder), key=lambda r: r.start)
    assert len(got) == len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert {r.n_tokens for r in got if r.doc_id in (40, 41)} == {1}


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_table(spark, docs, folder, name, stage):
    assert run(spark, stage, docs([]), folder) == []
