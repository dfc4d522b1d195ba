"""What steps leave on disk: shuffle files of written tables, tables of iterative operators, rounds of links that are settled."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from rwspark.llm import components as C
from rwspark.llm import quality
from rwspark.llm.common import CLEANUP, shared_dir, written


@pytest.fixture
def local_files(spark):
    """Counts shuffle files of this application."""
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return lambda: sum(f.startswith("shuffle_") for d in top for _, _, names in os.walk(d) for f in names)


def tables(spark):
    path = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(path) if x.startswith("rwspark-")} if os.path.isdir(path) else set()


def test_written_tables_leave_no_shuffle_files(spark, local_files):
    before, setting = local_files(), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = written(counts, "test")
    for _ in range(50):  # files are deleted behind the query's back
        if local_files() <= before:
            break
        time.sleep(0.1)
    assert local_files() <= before
    assert {r["k"]: r["count"] for r in out.collect()} == {r["k"]: r["count"] for r in counts.collect()}
    assert spark.conf.get(CLEANUP, None) == setting


def test_near_copies_leave_one_table(spark, docs):
    words = [f"w{i}" for i in range(300)]
    rows = docs([" ".join(words[i : i + 60]) + " end" * (k > 0) for i in range(0, 200, 20) for k in range(3)])
    spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)
    before = tables(spark)
    kept = P.ngram_jaccard(spark, rows, "")
    assert {x.split("-")[1] for x in tables(spark) - before} == {"classes"} and len(tables(spark) - before) == 1
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 3))


def test_search_for_determinants_leaves_the_last_ones(spark, docs):
    rows = docs([" ".join(f"w{(i * k) % 97}" for k in range(60 + i % 11)) + "\n#" for i in range(300)])
    stats = written(quality.statistics(rows, tuple(rows.columns)), "statistics")
    before = tables(spark)
    quality.judged(stats)
    assert sum("-mcd-" in x for x in tables(spark) - before) == 2


@pytest.mark.parametrize("few", [0, 200_000])
def test_settled_links_take_no_round(spark, monkeypatch, few):
    made = []
    monkeypatch.setattr(C, "written", lambda df, name: made.append(name) or written(df, name))
    stars = spark.createDataFrame([(9, 1), (1, 5), (7, 2), (9, 1), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in C.components(stars, few=few).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and made == ["links"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, 500) for i in range(400, 430)] + [(77, 500), (430, 60)], "a long, b long")
    got = {r.node: r.component for r in C.components(chain.unionByName(stars.limit(0)), few=few).collect()}
    assert got == {**dict.fromkeys([*range(61), 430], 0), **dict.fromkeys([*range(400, 430), 77, 500], 77)}
