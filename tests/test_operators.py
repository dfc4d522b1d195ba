"""Analytic fixtures, computed by hand, and brute-force versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rwspark import functions as R
from rwspark.operators import annotate, bleu, commit, latency, sampling, transport
from rwspark.plans.corpus import augmented

NAN = float("nan")


def cells(spark, matrix, n=None, id_=1):
    n, m = n or len(matrix), len(matrix[0])
    return spark.createDataFrame([(id_, n, m, i + 1, j, float(d)) for i, row in enumerate(matrix) for j, d in enumerate(row)], "id long, n int, m int, i int, j int, d double")


def trace(spark, matrix, tau=0.3):
    rows = commit.traces(cells(spark, matrix), tau).orderBy("j").collect()
    return [r.raw for r in rows], [r.commit for r in rows], rows[-1].chunk


def test_first_fire_and_fallback(spark):
    assert trace(spark, [(0.9, 0.8), (0.1, 0.7), (0, 0.2)]) == ([2, 3], [2, 3], 2)


def test_nan_is_skipped(spark):
    assert trace(spark, [(NAN, 0.9), (0.9, 0.9)]) == ([2, 2], [2, 2], 1)


def test_monotone(spark):
    rows = spark.createDataFrame([(1, j, c) for j, c in enumerate((1, 3, 2, 5))], "id long, j int, raw int")
    assert [r.commit for r in commit.monotone(rows).orderBy("j").collect()] == [1, 3, 3, 5]


@pytest.mark.parametrize("chunks, want", [([1, 1, 1], (1.0, True)), ([1, 4, 1], (0.5, True)), ([3, 4, 1], (0.3, False))])
def test_ladder(spark, chunks, want):
    rows = spark.createDataFrame([(1, 4, 4, k, t, c, 0) for k, (t, c) in enumerate(zip((0.3, 0.5, 1.0), chunks))], "id long, n int, m int, rung int, tau double, chunks int, sum_commit int")
    got = commit.ladder(rows).first()
    assert (got.tau_used, got.fell_back) == want


def test_rungs_above_primary_only():
    assert commit.rungs(0.3, [0.1, 0.5, 0.3, 1.0]) == [0.3, 0.5, 1.0]


def test_pearson_of_constant_commits_is_null(spark):
    assert commit.summaries(commit.traces(cells(spark, [(0.9, 0.9), (0.9, 0.9)]), 0.3)).first().pearson is None


def test_bins(spark):
    rows = spark.createDataFrame([(0.90,), (0.70,), (0.6999,), (NAN,), (None,)], "p double").select(commit.bin_for(F.col("p")))
    assert [r[0] for r in rows.collect()] == ["monotone", "mild", "reordering", "undefined", "undefined"]


def test_medians_and_quantiles(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 3.0), (2, NAN), (2, 5.0), (2, 5.0), (3, None)], "g int, x double")
    got = commit.order_statistics(rows, ["g"], "x", up=commit.upper_median, lo=commit.lower_median, p90=commit.index_quantile(0.9), half=commit.rounded_quantile(0.5))
    assert sorted(map(tuple, got.collect())) == [(1, 3.0, 2.0, 4.0, 3.0), (2, 5.0, 5.0, 5.0, 5.0)]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("sizes, want", [([1, 1, 3], [2, 3]), ([3, 1], [4]), ([1], [1]), ([], []), ([2, 2], [2, 2])])
def test_merge_small(spark, sizes, want):
    assert one(spark, R.merged_small(F.array(*map(F.lit, sizes)).cast("array<int>"), 2)) == want


def test_merge_small_is_the_restarted_loop(spark):
    rng = np.random.default_rng(5)
    cases = [rng.integers(1, 6, rng.integers(1, 12)).tolist() for _ in range(200)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>")
    for r in rows.select("i", R.merged_small(F.col("c"), 4).alias("m")).collect():
        out, held = [], 0
        for x in cases[r.i]:
            held += x
            if held >= 4:
                out.append(held)
                held = 0
        if held and out:
            out[-1] += held
        elif held:
            out = [held]
        assert r.m == out


def test_merge_to_n(spark):
    assert one(spark, R.merged_to(F.array(*map(F.lit, [1] * 5)), F.lit(2))) == [2, 3]
    assert one(spark, R.merged_to(F.array(*map(F.lit, [1] * 3)), F.lit(5))) == [1, 1, 1]


@pytest.mark.parametrize("k, want", [(3, []), (4, [("aug2", 2, "high")]), (6, [("aug2", 3, "high")]), (7, [("aug2", 4, "medium"), ("aug4", 2, "high")])])
def test_augment(spark, k, want):
    rows = spark.createDataFrame([(1, [f"s{i}" for i in range(k)], [f" t{i}" for i in range(k)], [[i, i] for i in range(k)])], "id long, source_chunks array<string>, target_chunks array<string>, source_chunk_ids array<array<int>>")
    got = augmented(rows, F.lit("ja")).collect()
    assert sorted((r.merge_tag, r.merged_to_n_chunks, r.latency) for r in got) == want
    for r in got:  # in lock-step, with a space between source texts and none between target texts
        assert " ".join(r.source_chunks) == " ".join(f"s{i}" for i in range(k)) and "".join(r.target_chunks) == "".join(f"t{i}" for i in range(k))
        assert [x for ids in r.source_chunk_ids for x in ids] == [x for i in range(k) for x in (i, i)] and [2 * len(s.split()) for s in r.source_chunks] == list(map(len, r.source_chunk_ids))


@pytest.mark.parametrize("n", [0, -1, 3, 4])
def test_nothing_to_merge(spark, n):
    assert one(spark, R.groups_to(F.array(*map(F.lit, "abc")), F.lit(n))) == [1, 1, 1]


@pytest.mark.parametrize("counts, want", [([1, 1, 3], [2, 1]), ([3, 1], [2]), ([1], [1]), ([], []), ([2, 2], [1, 1]), ([1, 1, 1], [3]), ([0, 2, 0, 0], [4])])
def test_groups_of_small_chunks(spark, counts, want):
    assert one(spark, R.small_groups(F.array(*map(F.lit, counts)).cast("array<int>"), 2)) == want


def test_latency_labels(spark):
    assert [one(spark, R.latency_for(F.lit(k))) for k in (3, 4, 6, 7)] == ["high", "medium", "medium", "low"]


def lagged(spark, g, x, y):
    return spark.createDataFrame([(1, x, y, g)], "id long, n int, m int, g array<int>")


@pytest.mark.parametrize("g, x, y, want", [(list(range(1, 10)), 9, 9, 1.0), ([3, 3, 3, 6, 6, 6, 9, 9, 9], 9, 9, 15 / 7), ([9] * 9, 9, 9, 9.0), ([], 0, 0, None)])
def test_average_lagging(spark, g, x, y, want):
    got = lagged(spark, g, x, y).select(latency.average_lagging(F.col("g"), F.col("n"), F.col("m"))).first()[0]
    assert got == want if want is None else math.isclose(got, want)


def test_wait_3_of_99(spark):
    tokens = spark.createDataFrame([(1, 99, 99)], "id long, n int, m int")
    got = latency.lags(latency.waitk(tokens, 3)).select(latency.average_lagging(F.col("g"), F.col("n"), F.col("m"))).first()[0]
    assert math.isclose(got, 195 / 97)


def test_dal(spark):
    assert math.isclose(latency.differentiable(lagged(spark, [3, 3, 3], 3, 3)).first().dal, 3.0)


def test_dal_is_the_recurrence(spark):
    rng = np.random.default_rng(1)
    for _ in range(10):
        x, y = int(rng.integers(1, 20)), int(rng.integers(1, 20))
        g = sorted(rng.integers(0, x + 1, y).tolist())
        r, last, total = x / y, None, 0.0
        for i, v in enumerate(g):
            last = max(v, (0.0 if last is None else last) + r) if i else max(v, r)
            total += last - i * r
        assert math.isclose(latency.differentiable(lagged(spark, g, x, y)).first().dal, total / y, rel_tol=1e-9)


@pytest.mark.parametrize("n, k, want", [(8, 3, [3, 6, 8]), (9, 3, [3, 6, 9]), (2, 3, [2])])
def test_wait_k_drain(spark, n, k, want):
    rows = latency.waitk(spark.createDataFrame([(1, n, 5)], "id long, n int, m int"), k)
    assert [r.commit for r in rows.orderBy("at").collect()] == want
    reads = spark.createDataFrame([(1, n, 5, i) for i in range(1, n + 1)], "id long, n int, m int, i int").withColumn("fires", latency.policy("wait_k", k=k))
    rows = latency.drained(reads).orderBy("at").collect()
    assert [r.commit for r in rows] == want and rows[0].exhausted == (n < k)


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        latency.policy("other")
    with pytest.raises(ValueError):
        R.criterion("other")
    with pytest.raises(Exception, match="unknown latency"):
        one(spark, R.user_instruction(F.lit("fast"), F.lit("de"), F.lit("en")))


def test_js_is_bounded(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(rng.dirichlet([0.1] * 8).tolist(), rng.dirichlet([0.1] * 8).tolist()) for _ in range(50)], "p array<double>, q array<double>")
    assert all(0 <= r[0] <= math.log(2) + 1e-9 for r in rows.select(R.js(F.col("p"), F.col("q"))).collect())
    assert abs(one(spark, R.js(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) - math.log(2)) < 1e-9


def test_transport_batched_is_single():
    rng = np.random.default_rng(0)
    v, vectors = 500, rng.normal(size=(500, 16))
    p, q = (rng.dirichlet([0.5] * v, 25) for _ in range(2))
    many = transport.batched(p, q, vectors, k=32, rounds=100)
    assert max(abs(many[i] - transport.single(p[i], q[i], vectors, k=32, rounds=100)) for i in range(25)) < 5e-3


def test_bleu_of_equal_texts_is_100(spark):
    rows = spark.createDataFrame([(1, "a b c d e, f.", "a b c d e, f.")], "id long, hyp string, ref string")
    assert math.isclose(bleu.corpus(rows).first().bleu, 100.0)


def test_bleu_by_hand(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on a mat")], "id long, hyp string, ref string")
    got = bleu.corpus(rows).first()
    assert (got.hits, got.totals) == ([5, 3, 2, 1], [6, 5, 4, 3])
    assert math.isclose(got.bleu, 100 * (5 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25)


def test_char_spans(spark):
    text, spans = F.lit("ab  ab cd"), lambda *c: [tuple(x) for x in one(spark, R.char_spans(F.lit("ab  ab cd"), F.array(*map(F.lit, c)))) or ()]
    assert spans("ab", "ab", "cd") == [(0, 2), (4, 6), (7, 9)]
    assert one(spark, R.char_spans(text, F.array(F.lit("cd"), F.lit("ab")))) is None
    assert one(spark, R.char_spans(text, F.array(F.lit("ab"), F.lit("")))) is None


def test_labels_and_padding(spark):
    ids = F.array(*map(F.lit, (5, 6, 7)))
    assert one(spark, R.labels(ids, F.lit(2))) == [-100, -100, 7]
    assert one(spark, R.labels(ids, F.lit(9))) == [-100] * 3
    assert one(spark, R.padded(ids, F.lit(5))) == [5, 6, 7, 0, 0]
    assert one(spark, R.find_subsequence(ids, F.array(F.lit(6), F.lit(7)))) == 1
    assert one(spark, R.first_difference(ids, F.array(F.lit(5), F.lit(0), F.lit(7)))) == 1


def test_annotation_invariants(spark):
    words = "a b c, d e f. g h".split()
    tokens = spark.createDataFrame([(1, words, words, 8, 8)], "id long, s array<string>, t array<string>, n int, m int")
    for scorer in ("hash", "prefix", annotate.external(lambda s, t: [np.tile([1 - len(x) / 9, len(x) / 9], (len(y), 1)) for x, y in zip(s, t)])):
        row = annotate.annotate(tokens, scorer, 0.3).first()
        assert len(row.source_chunks) == len(row.target_chunks) >= 1
        assert " ".join(row.source_chunks).split() == words == " ".join(row.target_chunks).split()


def test_group_split_keeps_groups_together(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(90)], "index long, x int")
    split = {(r["index"], r.split) for r in sampling.group_split(rows, 0.1).collect()}
    assert len(split) == 30 and sum(s == "eval" for _, s in split) == 3


def test_balanced_quota(spark):
    rows = spark.createDataFrame([(i, ("low", "medium", "high")[i % 3]) for i in range(90)], "index long, latency string")
    got = {r.latency: r["count"] for r in sampling.balanced(rows, 20).groupBy("latency").count().collect()}
    assert got == {"low": 6, "medium": 8, "high": 6}


def test_ranks_among_scores(spark):
    rows = spark.createDataFrame([(0.5, [0.1, 0.9, 0.5]), (0.95, [0.1, 0.9]), (0.0, [])], "p double, others array<double>")
    assert [r.k for r in rows.select(R.rank_of(F.col("p"), F.col("others")).alias("k")).collect()] == [2, 1, 1]


def test_fired_divergence(spark):
    cells = [(1, 3, 2, i, j, d) for i, row in enumerate([(0.9, 0.8), (0.1, 0.7), (0.0, 0.2)], 1) for j, d in enumerate(row)]
    cells += [(2, 2, 1, 1, 0, NAN), (2, 2, 1, 2, 0, 0.0), (3, 3, 2, 1, 0, 0.9), (3, 3, 2, 1, 1, 0.1), (3, 3, 2, 2, 0, 0.2), (3, 3, 2, 2, 1, NAN), (3, 3, 2, 3, 0, 0.0), (3, 3, 2, 3, 1, 0.0)]
    rows = spark.createDataFrame(cells, "id long, n int, m int, i int, j int, d double")
    got = {r.id: (r.fired, r.divergence) for r in commit.fired_divergence(rows, 0.3).collect()}
    assert got == {1: (1, 0.1), 2: (0, None), 3: (1, 0.2)}


def test_base_and_consistent_rows(spark):
    from rwspark import sources

    meta = "struct<augmented_from_base: boolean>"
    rows = spark.createDataFrame([(1, (True,)), (2, (False,)), (3, (None,)), (4, None)], f"k int, _annotator_meta {meta}")
    assert sorted(r.k for r in sources.base_rows(rows).collect()) == [2, 3, 4]
    rows = spark.createDataFrame([(1, [1, 2], [3], 2, 1), (2, [1], [3], 2, 1), (3, [], [], 0, 0), (4, None, [1], 1, 1)], "k int, s array<int>, t array<int>, n int, m int")
    assert sorted(r.k for r in sources.consistent(rows, "s", "t").collect()) == [1, 3]


def test_order_statistics_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 700), (None, 50)) for v in np.concatenate((rng.normal(0.95, 0.01, n), rng.choice([0.0, -1e300, 1e-9, 5.0, 5.0], n)))]
    rows += [("a", None), ("a", math.nan), ("none", math.nan), ("c", math.inf), ("c", -math.inf)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in commit.order_statistics(frame, ["g"], "v", lo=commit.lower_median, hi=commit.upper_median, q=commit.index_quantile(0.9), r=commit.rounded_quantile(0.25)).collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None and not math.isnan(x))
        n = len(v)
        assert (got[g].lo, got[g].hi, got[g].q, got[g].r) == (v[(n - 1) // 2], v[n // 2], v[int(n * 0.9)], v[round(0.25 * (n - 1))])
    assert "none" not in got
    counts = spark.range(1001).select(F.lit(1).alias("g"), (F.col("id") % 10).alias("v"))
    assert commit.order_statistics(counts, ["g"], "v", hi=commit.upper_median).first().hi == 4


def test_transport_of_small_eps_and_few_places():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6, 3))
    p, q = rng.dirichlet([1] * 6, 4), rng.dirichlet([1] * 6, 4)
    assert np.abs(transport.batched(p, p, vectors, eps=0.001, rounds=3000)).max() < 1e-3
    sharp, soft = transport.batched(p, q, vectors, eps=0.002, rounds=20_000), transport.batched(p, q, vectors, eps=0.05, rounds=2_000)
    assert np.isfinite(sharp).all() and (sharp <= soft + 1e-6).all()
    point = np.eye(6)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(transport.batched(point[:3], point[3:], vectors), [1 - unit[k] @ unit[k + 3] for k in range(3)], atol=1e-6)


def test_criteria_share_an_interface(spark):
    from rwspark.operators import criteria

    rng = np.random.default_rng(2)
    p, q, vectors = rng.dirichlet([0.3] * 7, 9), rng.dirichlet([0.3] * 7, 9), rng.normal(size=(7, 4))
    rows = spark.createDataFrame([(k, p[k].tolist(), q[k].tolist()) for k in range(9)], "id int, p array<double>, q array<double>")
    for name in criteria.ARRAYS:
        extra = {"vectors": vectors} if name == "ot" else {}
        got = [r.d for r in criteria.between(rows, name, **extra).orderBy("id").collect()]
        assert np.allclose(got, criteria.named(name)(p, q, **extra), atol=1e-9)
    for bad in (lambda: criteria.named("l2"), lambda: criteria.between(rows, "ot")):
        with pytest.raises(ValueError):
            bad()


def test_batched_scores_are_those_of_single_calls():
    rng, calls = np.random.default_rng(3), []

    def model(s, t):
        calls.append([len(x) for x in s])
        return [np.array([np.random.default_rng(len(x) * 100 + j).dirichlet([1] * 5) for j in range(len(y))]) for x, y in zip(s, t)]

    s = [["w"] * int(n) for n in rng.integers(1, 9, 30)]
    t = [["v"] * int(n) for n in rng.integers(1, 6, 30)]
    from rwspark.operators import criteria

    got = annotate.scored(s, t, model, criteria.js, most=4)
    assert all(len(set(c)) == 1 and len(c) <= 4 for c in calls) and sum(map(len, calls)) == sum(map(len, s))
    for x, y, d in zip(s, t, got):
        whole = model([x], [y])[0]
        assert np.allclose(d, [criteria.js(model([x[: i + 1]], [y])[0], whole) for i in range(len(x))])


def test_bleu_decodes_references(spark):
    rows = spark.createDataFrame([(1, "a &quot;b&quot; &amp;lt; c", 'a "b" &lt; c'), (2, None, "x"), (3, "", "y")], "id long, hyp string, ref string")
    got = rows.select("id", bleu.tokens(F.col("hyp")).alias("h"), bleu.tokens(F.col("ref")).alias("r")).orderBy("id").collect()
    assert got[0].h == ["a", '"', "b", '"', "<", "c"] and got[0].r == ["a", '"', "b", '"', "<", "c"] and got[1].h is None and got[2].h == []
    assert bleu.corpus(rows.filter("id <> 2")).first().hits == [6, 5, 4, 3]
