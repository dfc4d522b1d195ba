from __future__ import annotations

import pytest

from rwspark import plans
from tests.oracle import of_frame, of_sql


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, small, name):
    assert of_frame(plans.QUERIES[name](spark, small)) == of_sql(plans.ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
