"""The commit algebra within rows: the results of the one over cells, and no task that holds more than its share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rwspark import plans, sources
from rwspark import tokens as T
from rwspark.operators import annotate, commit, within
from tests.oracle import of_frame

TAUS = [0.2, 0.5, 0.7, 0.4]


def matrices(spark, seed: int = 4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        n, m = (int(x) for x in rng.integers(1, 9, 2))
        d = rng.random((n, m)).round(1)
        d[rng.random((n, m)) < 0.2] = math.nan
        rows.append((k, n, m, d.tolist(), [f"s{i}" for i in range(n)], [f"t{j}" for j in range(m)], sorted({*(int(x) for x in rng.integers(1, n + 1, 2)), n} if k % 3 else {1})))
    return spark.createDataFrame(rows, "id long, n int, m int, matrix array<array<double>>, s array<string>, t array<string>, at array<int>")


def score(i, j):
    return F.get(F.get("matrix", i - 1), j)


def cells(rows):
    return sources.from_matrices(rows.select(F.col("id").alias("index"), F.col("n").alias("n_src_tok"), F.col("m").alias("n_tgt_tok"), "matrix"))


def test_traces_and_chunks_are_those_of_cells(spark):
    rows = matrices(spark).persist()
    traced, old = within.traced(rows, score, 0.4), commit.traces(cells(rows), 0.4)
    assert of_frame(within.trace(traced)) == of_frame(old)
    assert of_frame(within.trace(within.traced(rows, score, 0.4, lambda i: F.array_min(F.filter(F.get("matrix", i - 1), lambda x: ~F.isnan(x)))))) == of_frame(old)
    assert of_frame(within.summaries(traced)) == of_frame(commit.summaries(old))
    for at in (None, F.col("at")):
        own = traced.withColumn("chunks", within.chunks(F.col("runs"), at))
        want = commit.chunked(old, rows, None if at is None else rows.select("id", "at"))
        assert of_frame(own.select("id", F.inline("chunks"))) == of_frame(want)
        assert of_frame(within.texts(own, "", "-").select("id", "source_chunks", "target_chunks")) == of_frame(commit.texts(want, rows, "", "-"))
    assert of_frame(within.fired_divergence(traced, score)) == of_frame(commit.fired_divergence(cells(rows), 0.4))


@pytest.mark.parametrize("least", [None, lambda i: F.lit(0.0), lambda i: F.array_min(F.filter(F.get("matrix", i - 1), lambda x: ~F.isnan(x)))])
def test_sweeps_are_those_of_cells(spark, least):
    rows = matrices(spark, 5)
    assert of_frame(within.swept(rows, score, TAUS, least)) == of_frame(commit.swept(cells(rows), TAUS))


def test_the_hash_scorer_is_one(spark, small):
    tokens = sources.token_pairs(spark, small).limit(5)
    rows = sources.cells(tokens).withColumn("again", (1.0 - F.col("i") / F.col("n")) * (0.2 + 0.8 * sources.hashed("id", "i", "j")))
    assert rows.filter("d <> again").count() == 0 and rows.filter(F.col("d") < sources.least_divergence(F.col("i"))).count() == 0


PLAIN = ("commit_first_fire commit_monotone chunk_count commit_chunks commit_stride_nan entropy_commit lowest_pearson_topk pearson_of_pearsons chunks_from_commit snap_boundary "
         "snap_word_marks token_id_chunks fired_divergence annotate_pairs annotate_transport prefix_divergence")


@pytest.mark.parametrize("name", [*PLAIN.split(), "random_floor", "tau_ladder", "collapse_drop", "flip_table", "matched_count"])
def test_pairs_are_not_dealt_anew(spark, small, name):
    """Cells never meet in the few tasks that a shuffle of narrow rows leaves: pairs stay where their conversation is, to a row each."""
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "Generate explode(sequence(1," not in plan
    if name in PLAIN.split():
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["lowest_pearson_topk", "pearson_of_pearsons", "collapse_drop"])
def test_no_cell_is_scored_twice(spark, small, name):
    assert plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString().count("md5(") == 1


def test_prefix_criteria_by_hand(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], 3)], "id long, s array<string>, n int").withColumn("m", F.lit(2))
    got = sorted((r.i, r.entropy, r.kl) for r in annotate.prefix_divergence(rows, 1.0).collect())
    p, q = [(2 / 3, 1 / 3), (2 / 4, 2 / 4), (3 / 5, 2 / 5)], (3 / 5, 2 / 5)
    want = [(i + 1, -sum(x * math.log(x) for x in p[i]), sum(y * math.log(y / x) for x, y in zip(p[i], q))) for i in range(3)]
    assert np.allclose(got, want, atol=1e-12)
    assert np.allclose([r.ot for r in annotate.prefix_transport(rows).orderBy("i").collect()][-1], annotate.with_transport(rows).first().ot[-1])


def test_encodings_of_a_batch_are_made_in_parts(spark, monkeypatch):
    texts = pa.array(["a" * 30, None, "", "b" * 300, "c", "d" * 90] + ["e"] * 9)
    assert [x for at, size in T.few(texts, 4, 100) for x in texts.slice(at, size).to_pylist()] == texts.to_pylist()
    parts = [texts.slice(at, size).to_pylist() for at, size in T.few(texts, 4, 100)]
    assert all(len(x) <= 4 and (sum(len(y or "") for y in x) <= 100 or len(x) == 1) for x in parts) and list(T.few(texts.slice(0, 0))) == []
    rows = spark.createDataFrame([(k, None if k % 7 == 3 else f"w{k} x y"[: k % 9]) for k in range(300)], "k int, x string").coalesce(1)
    whole = T.Hashed()
    for r in rows.select("x", T.encoded(F.col("x"), T.Spec()).alias("e")).collect():
        assert r.e is None if r.x is None else r.e.ids == whole.encode([r.x])[0].ids
