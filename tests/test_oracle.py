"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from blockpipe import suite
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF)
    assert res["status"] in ("ok", "ok@6"), res["status"]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["o_orderpriority", "net", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
