"""Plan properties of every registered query (the claims of PLANS.md)."""

import re

import pytest

from blockpipe import suite
from tests.plan_report import final_plan

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"pandas_block", "pandas_block_keyed", "pca_block"}


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_no_nested_loops_and_python_only_where_asked(spark, name):
    df = suite.QUERIES[name](spark, SF)
    df.collect()
    plan = final_plan(df)
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), plan
    has_python = bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan))
    assert has_python == (name in PYTHON_ALLOWED)
    # every query reads data: the given tables, or a checkpoint of data derived from them
    assert "FileScan" in plan or "Scan ExistingRDD" in plan
