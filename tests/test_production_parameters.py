"""Queries with the reference's own parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rwspark import plans, sources
from rwspark.operators import annotate, transport
from rwspark.plans import measures
from tests.oracle import of_frame, of_sql


def test_every_prefix_is_scored(spark, small):
    want = {r.id: (r.chunks, r.sum_commit) for r in annotate.annotate(sources.token_pairs(spark, small), "prefix", tau=0.05, stride=1).collect()}
    assert {r.id: (r.chunks, r.sum_commit) for r in plans.QUERIES["annotate_pairs"](spark, small).collect()} == want


def test_all_entries_are_transported(spark, small):
    angle = 2 * np.pi * np.arange(64) / 64
    rows = measures._distributions(spark, small).select("id", "p", "q").limit(50)
    want = {r.id: r.ot for r in transport.costs(rows, np.stack((np.cos(angle), np.sin(angle)), 1), k=64, rounds=200).withColumn("ot", F.round("ot", 5)).collect()}
    got = {r.id: r.ot for r in plans.QUERIES["ot_sinkhorn"](spark, small).collect()}
    assert all(got[i] == x for i, x in want.items())


def test_a_hundred_random_traces(spark, small):
    assert "range(100)" in plans.ORACLE["random_floor"]
    assert of_frame(plans.QUERIES["random_floor"](spark, small)) == of_sql(plans.ORACLE["random_floor"], small)
