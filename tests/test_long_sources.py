"""Sources of over 80 words: queries of whole pairs leave none out, in the code and in the SQL."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rwspark import plans, sources
from rwspark.operators import annotate, within
from tests.oracle import TABLES, of_frame, of_sql

SIZES = [(60, 25), (80, 20), (81, 30), (200, 25), (450, 40)]
#: Those without SQL last.
NAMES = ["chunk_count", "chunks_from_commit", "commit_chunks", "commit_first_fire", "commit_stride_nan", "entropy_commit", "fired_divergence", "lowest_pearson_topk", "matched_count", "tau_ladder", "annotate_transport"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, small):
    """The small tables, with conversations of sources of given lengths."""
    top = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "conversations":
            os.symlink(f"{small}/{t}.parquet", top / f"{t}.parquet")
    text = lambda k, n: " ".join(f"w{(i * 7 + k) % 31}" + ("," if i % 9 == 4 else "." if i % 13 == 12 else "") for i in range(n))
    rows = [(k, turn, role, text(k + turn, sizes[turn])) for k, sizes in enumerate(SIZES) for turn, role in enumerate(("user", "assistant"))]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
    pq.write_table(pa.table(columns, ["conv_id", "turn", "role", "text"]), top / "conversations.parquet")
    return str(top)


def test_pairs_are_of_any_length(spark, folder):
    assert sorted((r.n, r.m) for r in sources.token_pairs(spark, folder).collect()) == SIZES
    assert sorted((r.n, r.m) for r in sources.short_pairs(spark, folder).collect()) == SIZES[:2]


@pytest.mark.parametrize("name", NAMES)
def test_no_pair_is_left_out(spark, folder, name):
    rows = plans.QUERIES[name](spark, folder).persist()
    assert sorted(r.id >> 20 for r in rows.select("id").distinct().collect()) == list(range(len(SIZES)))
    if name in plans.ORACLE:
        assert of_frame(rows) == of_sql(plans.ORACLE[name], folder)


def test_transport_of_a_long_source_is_made_in_stretches(spark):
    rng = np.random.default_rng(3)
    places = rng.integers(0, 64, 2500)
    counts = (places[:, None] == np.arange(64)).cumsum(0)
    want = (counts + 0.1) / (np.arange(1, 2501)[:, None] + 6.4)
    parts = list(annotate.shares(places, 64, 0.1, 1000))
    assert [len(x) for x in parts] == [1000, 1000, 500] and (np.concatenate(parts) == want).all()
    rows = spark.createDataFrame([(k, [f"w{i * i % 97}" for i in range(n)], n) for k, n in enumerate((1, 30, 7, 90))], "id long, s array<string>, n int").coalesce(1)
    (one, two) = ({r.id: r.ot for r in annotate.with_transport(rows, most=most).collect()} for most in (1024, 16))
    assert all(len(one[k]) == n and np.allclose(one[k], two[k], atol=1e-7) for k, n in enumerate((1, 30, 7, 90)))


def test_summaries_of_very_long_pairs(spark):
    """Squares of the sums are beyond a long."""
    size, found = 100_000, [(10_000 * (k + 1), 10_000 * k, 10_000 * (k + 1) - 1) for k in range(10)]
    rows = spark.createDataFrame([(size, size, found)], "n int, m int, runs array<struct<commit: int, first: int, last: int>>")
    got = rows.select(within.summary(F.col("runs")).alias("s")).first().s
    want = np.corrcoef(np.repeat([c for c, _, _ in found], 10_000), np.arange(size))[0, 1]
    assert got.chunks == 10 and got.sum_commit == 10_000 * sum(c for c, _, _ in found) and abs(got.pearson - want) < 1e-9
