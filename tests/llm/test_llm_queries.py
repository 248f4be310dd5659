"""The registered queries against their SQL, over whole small tables."""

import pytest

import __spark_entry__ as entry
import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.MORE_SQL))
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert oracle.differences(spark, SMALL, lambda *_: df, entry.MORE_SQL[name]) is None


@pytest.mark.parametrize("name", ["op2_url_filter", "op10_decontamination"])
def test_native_operators_run_no_python(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
