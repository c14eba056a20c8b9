"""Band joins with hot buckets, and semi and anti joins on one inequality."""

import contextlib
import io
import math

import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe.operators import combine

KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def key(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def sides(spark):
    """Two thirds of either side hold one value; some rows are repeated, some are null."""
    value = F.when(F.col("id") % 3 > 0, 5.0).when(F.col("id") % 4 > 0, F.col("id") / 10.0)
    a = spark.range(300).select((F.col("id") % 290).alias("k"), value.alias("v"), (F.col("id") % 23).alias("w"))
    b = spark.range(240).select((F.col("id") % 230).alias("k"), value.alias("v"), (F.col("id") % 19).alias("u"))
    return a, b


@pytest.mark.parametrize("how", KINDS)
def test_hot_buckets_are_tiled_without_loss(sides, how):
    a, b = sides[0].alias("a"), sides[1].alias("b")
    cond = "b.v >= a.v - 1 and b.v <= a.v + 1 and a.w = b.u and a.w > 4"
    got = ops.join_on_condition(a, b, cond, how, band=("a.v", "b.v", -1, 1), tile_rows=16)
    want = a.join(b, F.expr(cond), how)
    assert got.columns == want.columns and key(got) == key(want)
    if how in ("inner", "left"):  # the sides' names still tell columns apart
        assert key(got.select("a.k", "b.v")) == key(want.select("a.k", "b.v"))


@pytest.mark.parametrize("how", KINDS)
def test_one_value_on_both_sides_of_one_table(spark, how):
    t = spark.range(200).select("id", F.lit(1.5).alias("v"))
    cond = "x.v <= y.v and y.v <= x.v + 1 and x.id < y.id"
    got = ops.join_on_condition(t.alias("x"), t.alias("y"), cond, how, band=("x.v", "y.v", 0, 1), tile_rows=20)
    assert key(got) == key(t.alias("x").join(t.alias("y"), F.expr(cond), how))


def test_tiles_bound_what_meets_in_one_task(spark):
    t = spark.range(2_000).select("id", F.lit(1).alias("v"), F.lit(1).cast("bigint").alias("_bp_bl"))
    right = t.withColumnRenamed("_bp_bl", "_bp_br")
    hot = combine._hot_buckets(t, right, 100)
    assert [tuple(r) for r in hot.collect()] == [(1, 20, 20)]
    pairs = combine._tiled(
        t.select(F.col("id").alias("x"), "_bp_bl"), right.select(F.col("id").alias("y"), "_bp_br"), hot, F.lit(True), "inner"
    )
    assert pairs.count() == 2_000**2 and pairs.distinct().count() == 2_000**2
    numbers = t.join(hot, F.col("_bp_bl") == F.col("_bp_b")).withColumn("i", F.monotonically_increasing_id())
    most = numbers.groupBy(F.pmod(F.xxhash64("i"), "_bp_tl")).count().agg(F.max("count")).first()[0]
    assert most < 2 * 100


def test_copies_for_tiles_grow_as_the_rows_do(spark):
    copies = []
    for n in (10_000, 40_000):
        t = spark.range(n).select("id", (F.col("id") % 3).alias("_bp_bl"))
        hot = combine._hot_buckets(t, t.withColumnRenamed("_bp_bl", "_bp_br"), 20).collect()
        assert len(hot) == 3 and sum(r._bp_tl * r._bp_tr for r in hot) <= 2 * combine.TILES
        copies.append(sum(n / 3 * (r._bp_tl + r._bp_tr) for r in hot))
    assert copies[1] <= 1.1 * 4 * copies[0]


@pytest.mark.parametrize("how", KINDS)
def test_tiles_larger_than_asked_lose_nothing(sides, how, monkeypatch):
    monkeypatch.setattr(combine, "TILES", 16)
    a, b = sides[0].alias("a"), sides[1].alias("b")
    cond = "b.v >= a.v - 1 and b.v <= a.v + 1 and a.w = b.u and a.w > 4"
    got = ops.join_on_condition(a, b, cond, how, band=("a.v", "b.v", -1, 1), tile_rows=2)
    assert key(got) == key(a.join(b, F.expr(cond), how))


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
@pytest.mark.parametrize("sign", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("on", [[], ["g.1"], ["g.1", "h"]])
def test_inequality_equals_all_pairs(spark, how, sign, on):
    left = [(i, i % 5 if i % 7 else None, i % 2, None if i % 11 == 0 else math.nan if i == 13 else float(i % 17)) for i in range(90)]
    right = [(i % 4 if i % 6 else None, i % 2, None if i % 10 == 0 else i % 9) for i in range(60)]
    a = spark.createDataFrame(left, "id int, `g.1` int, h int, x double").alias("a")
    b = spark.createDataFrame(right, "`g.1` int, h int, y int").alias("b")
    cond = F.expr(f"a.x {sign} b.y")
    for k in on:
        cond = cond & F.expr(f"a.`{k}` = b.`{k}`")
    got = ops.join_on_inequality(a, b, ("a.x", sign, "b.y"), on, how)
    assert key(got) == key(a.join(b, cond, how))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "NestedLoop" not in plan.getvalue() and "Cartesian" not in plan.getvalue()
    none = ops.join_on_inequality(a, b.where("false"), ("a.x", sign, "b.y"), on, how)
    assert none.count() == (0 if how == "left_semi" else 90)


def test_inequality_refuses_what_it_cannot_say(spark):
    a, b = spark.range(3).toDF("x"), spark.createDataFrame([("2",)], "y string")
    with pytest.raises(TypeError):
        ops.join_on_inequality(a, b, ("x", "<", "y"))
    with pytest.raises(ValueError):
        ops.join_on_inequality(a, a.toDF("y"), ("x", "=", "y"))
    with pytest.raises(ValueError):
        ops.join_on_inequality(a, a.toDF("y"), ("x", "<", "y"), how="inner")
