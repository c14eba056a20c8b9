"""Cases in which operators once gave wrong rows or failed."""

import math

import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"


def test_rows_that_differ_in_microseconds_are_no_duplicates(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1000000) as t from range(3)")
    found = ops.recommend_cleaning({"d": df}).where("technique like '%duplicate%'")
    assert found.count() == 0
    assert ops.recommend_cleaning({"d": df.unionAll(df)}).where("technique like '%duplicate%'").count() == 1


def test_split_full_join_with_columns_of_one_name(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (2, "z", 7), (None, "n", 8)], "k int, v string, a int")
    b = spark.createDataFrame([(1, "p", 1), (3, "q", 2), (3, "r", 3), (None, "s", 4)], "k int, v string, b int")
    plain = ops.join_on_keys(a, b, "k", "full")
    split = ops.join_on_keys(a, b, "k", "full", split_full=True)
    assert split.columns == plain.columns == ["k", "v", "a", "v", "b"]
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_band_join_of_huge_infinite_and_missing_values(spark, how):
    inf, nan = math.inf, math.nan
    values = [0.0, 1.0, 1.5, -3.0, 1e15, 4.6e15, -4.6e15, 1e300, -1e300, 1e17, 1e17 + 16, inf, -inf, nan, None]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    right = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "j int, y double")
    cond = "y >= x - 1 and y <= x + 1"
    got = ops.join_on_condition(left, right, cond, how, band=("x", "y", -1, 1))
    want = ops.join_on_condition(left, right, cond, how, all_pairs=True)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_band_join_of_long_whole_numbers(spark):
    left = spark.createDataFrame([(x,) for x in (0, 5, 2**62, 2**63 - 1, -(2**63))], "x long")
    right = spark.createDataFrame([(x,) for x in (1, 4, 2**62 + 1, 2**63 - 2, -(2**63) + 1)], "y long")
    cond = "cast(y as decimal(28,0)) between cast(x as decimal(28,0)) - 2 and cast(x as decimal(28,0)) + 2"
    got = ops.join_on_condition(left, right, cond, band=("x", "y", -2, 2)).collect()
    assert sorted(map(tuple, got)) == [(-(2**63), -(2**63) + 1), (0, 1), (5, 4), (2**62, 2**62 + 1), (2**63 - 1, 2**63 - 2)]


def test_nan_inside_nested_values_is_shown_as_null(spark):
    df = spark.sql(
        "select named_struct('a', double('NaN'), 'b', array(float('NaN'), 1.5f)) as s, "
        "map('k', double('NaN'), 'l', 2d) as m, cast(null as struct<a: double>) as n, array(1) as i"
    )
    shown = str(ops.preview_records(df))
    if hasattr(ops.preview_records(df), "collect"):
        shown = str([tuple(r) for r in ops.preview_records(df).collect()])
    assert "NaN" not in shown and "nan" not in shown and "1.5" in shown


@pytest.fixture()
def dotted(spark):
    rows_ = [(1, " a b ", "2020-01-02", 1.0, "x"), (1, None, "bad", 3.0, "x"), (2, "c d", "2021-05-06", None, "y")]
    return spark.createDataFrame(rows_, "`k.x` int, `t.x` string, `d.x` string, `v.x` double, `s.x` string")


def test_columns_with_dots(spark, dotted):
    assert ops.drop_missing(dotted, subset=["t.x"]).count() == 2
    assert ops.correct_types(dotted, {"d.x": "date"}).where("`d.x` is null").count() == 1
    assert ops.standardize_text(dotted, "t.x").first()["t.x"] == "AB"
    timed = ops.parse_time(dotted, "d.x")
    assert dict(timed.dtypes)["d.x"] == "timestamp_ntz"
    assert ops.years_between(timed, "d.x", "2024-01-01").first()["age"] == 3
    assert ops.split_column(dotted, "t.x", ["p", "q"]).columns[-2:] == ["p", "q"]
    total = ops.aggregate(dotted, "k.x", {"n": ("count", "*"), "v.sum": ("sum", "v.x")})
    assert {tuple(r) for r in total.collect()} == {(1, 2, 4.0), (2, 1, None)}
    assert ops.reduce_rows(dotted, {"x": 1.0}, "k.x", strata="s.x").count() == 2
    for method in ("window", "ranked"):
        smooth = ops.smooth(dotted, "v.x", "k.x", "d.x", out="m.x", method=method)
        assert sorted(str(r["m.x"]) for r in smooth.collect()) == ["1.0", "2.0", "None"]
    for strategy in ("mean", "median", "mode"):
        assert ops.impute(dotted, "v.x", strategy).where("`v.x` is null").count() == 0


def test_summary_named_like_a_key_is_refused(spark):
    with pytest.raises(ValueError, match="named like a key"):
        ops.aggregate(spark.range(3), "id", {"id": ("sum", "id")})


@pytest.mark.parametrize("sep", ["\\E", "\\Q", "a\\Eb", "|", "\\"])
def test_any_separator_splits(spark, sep):
    df = spark.createDataFrame([(f"x{sep}y",)], "t string")
    assert tuple(ops.split_column(df, "t", ["a", "b"], sep).select("a", "b").first()) == ("x", "y")


@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_impute_beside_columns_named_like_its_own(spark, strategy):
    df = spark.createDataFrame([(1, 2.0, 9.0), (1, None, 8.0)], "k int, v double, _bp_fill_v double")
    got = ops.impute(df, "v", strategy, by="k")
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, 8.0), (1, 2.0, 9.0)]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_smoothing_plans_are_equal_bit_for_bit(spark, window):
    df = spark.range(200).select(
        (F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 11 != 0, F.col("id") * 0.1 + 0.3).alias("v")
    )
    plain = ops.smooth(df, "v", "k", "id", window, out="m", method="window").collect()
    for chunk in (window, 7, 50):
        ranked = ops.smooth(df, "v", "k", "id", window, out="m", method="ranked", chunk_rows=chunk)
        assert ranked.columns == ["k", "id", "v", "m"]
        assert sorted(map(tuple, ranked.collect()), key=str) == sorted(map(tuple, plain), key=str)


def test_smoothing_queries_still_match_sql(spark):
    from blockpipe import suite

    for name in [n for n in suite.QUERIES if "moving" in n or "smooth" in n]:
        got = suite.QUERIES[name](spark, SF).toPandas()
        assert rows(got, 6) == rows(duck(SF).sql(suite.ORACLE_SQL[name]).df(), 6), name
