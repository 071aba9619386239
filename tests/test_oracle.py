"""Every memory query against its SQL, row by row."""

from __future__ import annotations

import pytest

from memlake.plans import oracle, queries, verbs, verbs_sql
from tests.oracle_check import connection, compare

QUERIES, SQL = queries.REGISTRY | verbs.REGISTRY, oracle.SQL | verbs_sql.SQL


@pytest.fixture(scope="module")
def con():
    return connection()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_plan_has_one_exchange(spark):
    """All ranks share the owner's partitioning; filters and columns reach the scan."""
    plan = queries.recall_keyword_recency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan


def test_topk_is_limited_before_the_exchange(spark):
    plan = queries.recency_topn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
