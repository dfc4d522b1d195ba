"""Targets of pairs are whole, in the operators and in the SQL."""

from __future__ import annotations

import re

import pytest

from rwspark import plans, sources
from tests.oracle import of_frame, of_sql

def test_targets_are_whole(spark, small):
    long = {r.id: r.target for r in sources.pairs(spark, small).collect() if len(re.findall(r"\S+", r.target)) > 60}
    got = {r.id: (list(r.t), r.m) for r in sources.token_pairs(spark, small).collect()}
    assert long.keys() & got.keys()
    assert all(got[i] == (re.findall(r"\S+", t), len(re.findall(r"\S+", t))) for i, t in long.items() if i in got)


@pytest.mark.parametrize("name", ["commit_chunks", "tau_sweep", "chunk_texts", "waitk_trace", "al"])
def test_query_matches_whole_sql(spark, small, name):
    assert "t[1:" not in plans.ORACLE[name] and of_frame(plans.QUERIES[name](spark, small)) == of_sql(plans.ORACLE[name], small)
