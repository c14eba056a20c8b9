"""Exact quantiles by narrowing: equal to ``percentile`` bit by bit, no range exchange."""

import contextlib
import io
import math
import struct

import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe.plans import quantiles
from blockpipe.plans import ranking

PROBS = [0.0, 0.001, 0.25, 0.5, 0.501, 0.93, 1.0]


def bits(rows):
    return sorted(tuple(struct.pack(">d", x) if isinstance(x, float) else repr(x).encode() for x in r) for r in rows)


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 has two thirds of the rows, a third of them one value; key null too has rows."""
    key = F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 4 > 0, F.col("id") % 40)
    value = F.when(F.col("id") % 5 == 0, F.lit(7.25)).otherwise(F.pow(F.rand(3), 9) * F.when(F.rand(4) < 0.4, -1e9).otherwise(1e-3))
    df = spark.range(60_000).select("id", key.alias("k"), value.alias("v"))
    return spark.createDataFrame(df.toArrow()).cache()


@pytest.mark.parametrize("how", [{"method": "narrowed"}, {"max_group_rows": 50}, {"max_group_rows": 5_000}])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_equal_to_percentile_bit_by_bit(hot, how, by):
    want = quantiles(hot, "v", PROBS, by=by, method="percentile").collect()
    assert bits(quantiles(hot, "v", PROBS, by=by, **how).collect()) == bits(want)


def test_values_at_the_edges_of_doubles(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 1.0, math.nextafter(1.0, 2), 2.0,
              math.nextafter(2.0, 0), 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e300]
    df = spark.createDataFrame([(v,) for v in values for _ in range(3)] + [(None,), (math.nan,)], "v double")
    probs = [i / 44 for i in range(45)]
    want = quantiles(df, "v", probs, method="percentile").collect()
    assert bits(quantiles(df, "v", probs, method="narrowed").collect()) == bits(want)
    assert bits(quantiles(df, "v", probs, max_group_rows=4).collect()) == bits(want)


def test_close_values_far_from_zero_are_told_apart(spark):
    df = spark.range(5_000).select((F.lit(1e15) + F.col("id") % 977 / 8).alias("v"))
    want = quantiles(df, "v", PROBS, method="percentile").collect()
    assert bits(quantiles(df, "v", PROBS, method="narrowed").collect()) == bits(want)


def test_no_rows_and_only_missing(spark):
    none = spark.createDataFrame([(None, 1), (math.nan, 2)], "v double, `a.b` int")
    assert [tuple(r) for r in quantiles(none, "v", [0.5], method="narrowed").collect()] == [(None,)]
    assert quantiles(none, "v", [0.5], by=["a.b"], method="narrowed").collect() == []
    some = none.unionAll(spark.createDataFrame([(4.0, 2), (6.0, 2)], "v double, `a.b` int"))
    assert [tuple(r) for r in quantiles(some, "v", [0.5], by=["a.b"], method="narrowed").collect()] == [(2, 5.0)]


def test_rows_are_neither_sorted_nor_written(spark, hot, monkeypatch):
    """Only the sizes of big groups and the targets are written: bounded by what is gathered."""
    written, measured = [], ranking.measured

    def noted(df):
        out = measured(df)
        written.append(out[1])
        return out

    monkeypatch.setattr(ranking, "measured", noted)
    monkeypatch.setattr(ranking, "rank_within", None)
    out = quantiles(hot, "v", [0.25, 0.5], by=["k"], max_group_rows=1_000)
    assert len(out.collect()) == hot.select("k").distinct().count()
    assert written and max(written) <= 2 * 60_000 / 1_000
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert "rangepartitioning" not in plan.getvalue()


def test_operators_take_the_method(hot):
    for op in (
        lambda m: ops.impute(hot, "v", "median", by="k", quantile_method=m),
        lambda m: ops.drop_outliers(hot, "v", quantile_method=m),
        lambda m: ops.discretize(hot, "v", "quantile", n=9, quantile_method=m),
    ):
        assert bits(op("narrowed").collect()) == bits(op("percentile").collect())
