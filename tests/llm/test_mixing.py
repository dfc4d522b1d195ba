from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rwspark.llm import mixing as M


def weighted(spark, weights):
    return spark.createDataFrame(list(weights.items()), "source string, weight double")


def worst(mix, weights, step=1):
    """Largest distance, in documents, between what a source has had and its share of the documents so far."""
    total, had, found = sum(weights.values()), dict.fromkeys(weights, 0), 0.0
    for n, source in enumerate(mix, 1):
        had[source] += 1
        if n % step == 0:
            found = max(found, *(abs(had[s] - n * w / total) for s, w in weights.items()))
    return found


@pytest.mark.parametrize("slots, frame", [(64, 16), (4096, 256)])
@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5003, "b": 0.4997}, {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1e-4}, {f"s{i}": 1.0 + i * i % 17 for i in range(25)}])
def test_less_than_one_block_off_the_given_weights(spark, weights, slots, frame):
    names = list(weights)
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id"), F.lit(len(names))) + 1).cast("int")).alias("source"))
    rows = rows.filter("source <> 'd' OR doc_id % 1000 = 0")
    got = M.mixed(rows, weighted(spark, weights), slots=slots, frame=frame).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got)))
    block = M.shares(rows, weighted(spark, weights), 0.7, slots).first().block
    there = {r.source for r in got}
    assert worst([r.source for r in got], {s: w for s, w in weights.items() if s in there}, 7) <= block
    assert {r.doc_id for r in got if r.epoch == 0} == {r.doc_id for r in rows.collect()}


def test_drift_over_many_slots(spark):
    """Weights that no small whole numbers express, over thousands of slots."""
    plan = [("=a", 500_300_000_000, 10**12, 3000, 3000, 6000), ("=b", 499_700_000_000, 10**12, 2900, 2900, 6000)]
    rows = spark.createDataFrame(plan, "stream string, q long, total long, need long, docs long, slots long")
    got = [r.stream[1] for r in M.schedule(rows).orderBy("slot").collect()]
    assert len(got) > 5900 and worst(got, {"a": 0.5003, "b": 0.4997}) < 1


def test_length_is_that_of_a_first_pass(spark, docs):
    """Equal sources give each document once; with unequal shares, the mix ends as the last source has."""
    got = M.mixed(docs([(i, "", "en", f"s{i % 20}") for i in range(1000)])).collect()
    assert len(got) == 1000 and {r.epoch for r in got} == {0}
    rows = docs([(i, str(i), "en", "ab"[i % 10 == 0]) for i in range(1000)])
    got = M.mixed(rows, weighted(spark, {"a": 3.0, "b": 1.0})).orderBy("position").collect()
    assert 1196 <= len(got) <= 1200 and {r.doc_id for r in got if r.epoch == 0} == set(range(1000)) and got[-1].epoch == 0


def test_small_sources(spark, docs):
    """More sources than slots: those under a block share a stream, and none is left out."""
    rows = docs([(i, "", "en", f"s{i}" if i < 300 else "hot") for i in range(3000)])
    got = M.mixed(rows, slots=64).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got))) and {r.doc_id for r in got if r.epoch == 0} == set(range(3000))
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_order_does_not_depend_on_partitions(spark, docs):
    rows = docs([(i, "", "en", f"s{i % 3}") for i in range(300)])
    key = lambda df: sorted((r.position, r.doc_id) for r in df.collect())
    assert key(M.mixed(rows)) == key(M.mixed(rows.repartition(7)))


def test_edges(spark, docs, edge_texts):
    assert M.mixed(docs([])).count() == 0
    rows = docs([(None, None, None, None), (1, "", "en", ""), (1, "", "en", ""), (2, "x", "en", None)] + [(3 + i, t, None, "long") for i, t in enumerate(edge_texts)])
    got = M.mixed(rows)
    assert got.filter("epoch = 0").count() == 4 + len(edge_texts) and got.filter("epoch = 0").select("text").exceptAll(rows.select("text")).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        M.mixed(docs([(1, "", "", "q")]), weighted(spark, {"a": 1.0})).collect()
    with pytest.raises(Exception, match="negative weight for source"):
        M.mixed(docs([(1, "", "", "a")]), weighted(spark, {"a": -1.0})).collect()
    got = M.mixed(docs([(1, "", "", "a"), (2, "", "", "b")]), weighted(spark, {"a": 1.0, "b": 0.0})).collect()
    assert [r.doc_id for r in got] == [1]


def test_clashing_names(spark, docs):
    """Columns of the mix's own names are replaced, all others come back as they were."""
    rows = docs([(i, "", "en", f"s{i % 3}") for i in range(30)], extra=True)
    names = ("slot", "position", "epoch", "period", "block", "docs", "given", "stream", "total", "q")
    for name in names:
        rows = rows.withColumn(name, F.lit("clash"))
    got = M.mixed(rows)
    assert sorted(got.columns) == sorted(rows.columns)
    kept = [c for c in rows.columns if c not in ("slot", "position", "epoch")]
    assert got.select(kept).distinct().exceptAll(rows.select(kept)).count() == 0 and dict(got.dtypes)["position"] == "bigint"


def test_any_column_is_kept(spark, docs):
    rows = docs(["a", "b", None]).selectExpr("*", "'u' AS _mix_source", "'v' AS _mix_key", "'w' AS _mix_row", "'x' AS stream", "9 AS slot")
    got = M.mixed(rows)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_mix_source", "_mix_key", "_mix_row", "stream", "slot", "position", "epoch"]
    assert {(r._mix_source, r._mix_key, r._mix_row, r.stream) for r in got.collect()} == {("u", "v", "w", "x")} and {r.slot for r in got.collect()} == {0, 1, 2}


def test_many_sources_are_planned(spark):
    """Windows of all of them hold, in a time that grows with slots times sources."""
    n = 600
    rows = spark.range(n).selectExpr("concat('=', id) AS stream", "1L AS q", f"{n}L AS total", "2L AS need", "2L AS docs", f"{n}L AS slots")
    got = M.schedule(rows).collect()
    assert sorted(r.slot for r in got) == list(range(2 * n)) and all(r.turn * n <= r.slot < (r.turn + 1) * n for r in got)
