import random

import pytest

from blockpipe import operators as ops


def test_integrate_precedence(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id int, name string, score int")
    b = spark.createDataFrame([(1, "X", 7), (3, "z", 9)], "id int, name string, score int")
    c = spark.createDataFrame([(3, True)], "id int, flag boolean")
    rows = {r.id: r for r in ops.integrate({"a": a, "b": b, "c": c}, "id").collect()}
    assert (rows[1].name, rows[1].score) == ("x", 7)
    assert (rows[2].name, rows[2].score, rows[2].flag) == ("y", 5, None)
    assert (rows[3].name, rows[3].flag) == ("z", True)
    flipped = {r.id: r.name for r in ops.integrate({"a": a, "b": b}, "id", precedence=["b", "a"]).collect()}
    assert flipped[1] == "X"


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_join_on_keys(spark, how):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    r = spark.createDataFrame([(2, "B"), (3, "C")], "k int, y string")
    n = ops.join_on_keys(l, r, "k", how).count()
    assert n == {"inner": 1, "left": 2, "right": 2, "full": 3, "left_semi": 1, "left_anti": 1}[how]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_band_join_matches_nested_loop(spark, how):
    rnd = random.Random(11)
    lrows = [(i, rnd.uniform(-500, 500)) for i in range(300)]
    rrows = [(j, rnd.uniform(-500, 500)) for j in range(300)]
    l = spark.createDataFrame(lrows, "li int, lv double")
    r = spark.createDataFrame(rrows, "ri int, rv double")
    cond = "lv - 3 <= rv and rv < lv + 17"
    band = ops.join_on_condition(l, r, cond, how, band=("lv", "rv", -3, 17))
    plain = ops.join_on_condition(l, r, cond, how, all_pairs=True)
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(band) == key(plain)


def test_union_checks_schema(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert ops.union([a, b]).count() == 2
    assert ops.union([a, a], distinct=True).count() == 1
    bad = spark.createDataFrame([("1", "x")], "k string, v string")
    with pytest.raises(ValueError):
        ops.union([a, bad])


def test_split_full_join_equals_full_join(spark):
    # key 0 holds a third of the left rows
    l = spark.createDataFrame([(0 if i % 3 == 0 else i, f"l{i}") for i in range(300)], "k int, x string")
    r = spark.createDataFrame([(i * 2, f"r{i}") for i in range(-5, 200)], "k int, y string")
    plain = ops.join_on_keys(l, r, "k", "full")
    split = ops.join_on_keys(l, r, "k", "full", split_full=True)
    assert split.columns == plain.columns
    key = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    assert key(split) == key(plain)


def test_integrate_repeated_keys(spark):
    a = spark.createDataFrame([(1, "b", "y"), (1, "a", "z"), (2, None, None)], "id int, v string, w string")
    b = spark.createDataFrame([(2, "z", "q")], "id int, v string, w string")
    with pytest.raises(Exception, match="dataset 'a' has a repeated value"):
        ops.integrate({"a": a, "b": b}, "id").collect()
    rows = {r.id: (r.v, r.w) for r in ops.integrate([a, b], "id", on_duplicate="merge").collect()}
    assert rows == {1: ("a", "z"), 2: ("z", "q")}  # the record is one of the table's own


def test_integrate_null_keys_maps_and_clashing_types(spark):
    a = spark.createDataFrame([(None, "n1"), (1, "x")], "id int, v string")
    b = spark.createDataFrame([(None, "n2"), (1, "y"), (None, "n3")], "id int, v string")
    got = sorted((r.id or 0, r.v) for r in ops.integrate([a, b], "id").collect())
    assert got == [(0, "n1"), (0, "n2"), (0, "n3"), (1, "x")]
    with pytest.raises(ops.SchemaClashError):
        ops.integrate([a, spark.createDataFrame([(1, 2)], "id int, v int")], "id")
    m = spark.sql("select 1 as id, map('k', 1) as m")
    assert ops.integrate([m, a], "id").where("id = 1").collect()[0].m == {"k": 1}
    with pytest.raises(ValueError):
        ops.integrate([m], "id", on_duplicate="merge")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize("kind", ["double", "decimal(10,1)", "bigint"])
def test_band_join_loses_no_pair(spark, how, kind):
    scale = 10 if kind == "bigint" else 1
    base = 2**60 if kind == "bigint" else 0
    a = spark.range(120).selectExpr("id as a_id", f"cast({base} + id * {scale} / 10.0 as {kind}) as a")
    b = spark.range(0, 240, 2).selectExpr("id as b_id", f"cast({base} + (id - 50) * {scale} / 10.0 as {kind}) as b")
    if kind == "bigint":
        a = spark.range(120).selectExpr("id as a_id", f"{base}L + id as a")
        b = spark.range(0, 240, 2).selectExpr("id as b_id", f"{base}L + id - 50 as b")
    cond, band = ("b >= a and b <= a + 1", (0, 1)) if kind == "bigint" else ("b >= a and b <= a + 0.1", (0, 0.1))
    got = ops.join_on_condition(a, b, cond, how, band=("a", "b", *band))
    want = ops.join_on_condition(a, b, cond, how, all_pairs=True)
    key = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and key(got) == key(want)


def test_all_pairs_must_be_asked_for(spark):
    a, b = spark.range(3).toDF("x"), spark.range(3).toDF("y")
    with pytest.raises(ops.AllPairsError):
        ops.join_on_condition(a, b, "x < y")
    assert ops.join_on_condition(a, b, "x < y", all_pairs=True).count() == 3
    assert ops.join_on_condition(a, b, "x = y and x < 2").count() == 2
