"""Plan shape of every registered query: no pair-emitting joins, no Python in the hot path."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in E.queries() if not k.startswith("snapshot_")))
def test_no_pairwise_joins_or_python(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["monthly_trend"](spark, SF_SMALL))
    # the order lines are read with only the columns the trend needs
    assert "ReadSchema: struct<order_id:bigint,product_id:bigint,quantity:int>" in plan


def test_customer_filter_pushed(spark):
    plan = _plan(E.queries()["customers"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,active)]" in plan
