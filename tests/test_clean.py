import pytest
from pyspark.errors import PySparkException

from blockpipe import operators as ops
from blockpipe.functions import standardize_name


def test_drop_missing_counts_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (None, 2.0)], "a int, b double")
    assert sorted(r.a for r in ops.drop_missing(df).collect()) == [1]
    assert ops.drop_missing(df, how="all").count() == 4
    assert sorted(r.a or 0 for r in ops.drop_missing(df, subset=["b"]).collect()) == [0, 1]


def test_drop_duplicates_keep_by(spark):
    df = spark.createDataFrame([(3, "x", "c"), (1, "x", "a"), (2, "y", "b"), (5, "y", "e")], "id int, k string, v string")
    first = {r.k: (r.id, r.v) for r in ops.drop_duplicates(df, ["k"], keep_by="id").collect()}
    last = {r.k: (r.id, r.v) for r in ops.drop_duplicates(df, ["k"], keep_by="id", keep="last").collect()}
    assert first == {"x": (1, "a"), "y": (2, "b")}
    assert last == {"x": (3, "c"), "y": (5, "e")}
    assert ops.drop_duplicates(df.union(df)).count() == 4


def _vals(df, key="id", col="v"):
    return {r[key]: r[col] for r in df.collect()}


def test_impute_strategies(spark):
    rows = [(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "a", 3.0), (5, "b", float("nan")), (6, "b", 10.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    assert _vals(ops.impute(df, "v", "constant", value=0.0))[2] == 0.0
    assert _vals(ops.impute(df, "v", "constant", value=0.0))[5] == 0.0
    assert _vals(ops.impute(df, "v", "mean"))[2] == pytest.approx((1 + 3 + 3 + 10) / 4)
    assert _vals(ops.impute(df, "v", "median"))[2] == pytest.approx(3.0)
    by_group = _vals(ops.impute(df, "v", "median", by="g"))
    assert by_group[2] == 3.0 and by_group[5] == 10.0
    ranked = _vals(ops.impute(df, "v", "median", by="g", quantile_method="ranked"))
    assert ranked == by_group
    assert _vals(ops.impute(df, "v", "mode", by="g"))[2] == 3.0
    approx = _vals(ops.impute(df, "v", "median", approx=True))
    assert approx[2] == 3.0


def test_impute_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, v string")
    assert _vals(ops.impute(df, "v", "mode"))[3] == "a"


def test_impute_null_group_key(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "id int, g string, v double")
    assert _vals(ops.impute(df, "v", "mean", by="g"))[2] == 1.0


def test_correct_types(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",)], "p string")
    assert [r.p for r in ops.correct_types(df, {"p": "double"}).collect()] == [1.5, None]
    with pytest.raises(PySparkException):
        ops.correct_types(df, {"p": "double"}, on_error="fail").collect()


def test_standardize_text(spark):
    df = spark.createDataFrame([("  big  red\tbox ",)], "s string")
    assert ops.standardize_text(df, "s").collect()[0].s == "BIGREDBOX"
    assert ops.standardize_text(df, "s", case="lower", spaces="collapse").collect()[0].s == "big red box"


def test_map_values_dict_and_table(spark):
    df = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), (None,)], "s string")
    m = {"AUTOMOBILE": "AUTO"}
    assert [r.s for r in ops.map_values(df, "s", m).collect()] == ["AUTO", "BUILDING", None]
    table = spark.createDataFrame([("AUTOMOBILE", "AUTO")], "f string, t string")
    assert sorted(str(r.s) for r in ops.map_values(df, "s", table).collect()) == ["AUTO", "BUILDING", "None"]
    big = {f"k{i}": f"v{i}" for i in range(20_000)}
    big["BUILDING"] = "BLD"
    assert sorted(str(r.s) for r in ops.map_values(df, "s", big).collect()) == ["AUTOMOBILE", "BLD", "None"]


def test_standardize_name_values_and_columns(spark):
    df = spark.createDataFrame([("Hello World",), (" Test Case ",), ("NoSpaces",)], "s string")
    assert [r.s for r in df.select(standardize_name("s").alias("s")).collect()] == [
        "hello_world", "test_case", "nospaces"]
    cols = spark.createDataFrame([(1, 2)], "`Hello World` int, ` Test Case ` int")
    assert ops.standardize_names(cols).columns == ["hello_world", "test_case"]
    clash = spark.createDataFrame([(1, 2)], "`A b` int, `a B` int")
    with pytest.raises(ValueError):
        ops.standardize_names(clash)


def test_impute_by_group_without_broadcast(spark):
    """Statistics too big to broadcast: the same answer through a shuffle join."""
    rows = [(i, i % 5, None if i % 4 == 0 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    want = _vals(ops.impute(df, "v", "median", by="g", quantile_method="ranked"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ops.impute(df, "v", "median", by="g", quantile_method="ranked")
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert _vals(out) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)



@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_impute_several_columns_group_missing_in_one(spark, strategy):
    rows = [(1, "a", None, 1.0), (2, "a", None, 3.0), (3, "b", 5.0, None), (4, "b", 7.0, 2.0), (5, "b", None, 2.0),
            (6, "a", None, None)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    out = {r.id: (r.x, r.y) for r in ops.impute(df, ["x", "y"], strategy, by="g").collect()}
    assert out[1] == (None, 1.0)  # group a has no x at all: stays missing
    assert out[6] == (None, {"mean": 2.0, "median": 2.0, "mode": 1.0}[strategy])  # but its y is filled
    assert out[3][1] == 2.0  # group b's y is filled even though group a lacks x
    assert out[5][0] == {"mean": 6.0, "median": 6.0, "mode": 5.0}[strategy]



def test_drop_duplicates_missing_keep_by_never_wins(spark):
    df = spark.createDataFrame([(None, "x", "a"), (2, "x", "b"), (5, "x", "c"), (None, "y", "d")],
                               "id int, k string, v string")
    first = {r.k: r.v for r in ops.drop_duplicates(df, ["k"], keep_by="id").collect()}
    last = {r.k: r.v for r in ops.drop_duplicates(df, ["k"], keep_by="id", keep="last").collect()}
    assert first == {"x": "b", "y": "d"} and last == {"x": "c", "y": "d"}



def test_modes_of_several_columns_in_one_pass(spark):
    from blockpipe.plans import group_modes

    rows = [("a", 1, "x", 2.0), ("a", 1, "y", float("nan")), ("a", 2, "y", 3.0), ("a", 2, None, 3.0),
            ("b", None, "z", None), ("b", 7, "z", 1.0)]
    df = spark.createDataFrame(rows, "g string, n int, s string, d double")
    got = {r.g: (r.mn, r.ms, r.md) for r in group_modes(df, ["n", "s", "d"], ["g"], ["mn", "ms", "md"]).collect()}
    assert got == {"a": (1, "y", 3.0), "b": (7, "z", 1.0)}
    whole = group_modes(df, ["n", "s"], names=["mn", "ms"]).collect()[0]
    assert (whole.mn, whole.ms) == (1, "y")  # y and z tie twice each: the smaller wins



def test_standardize_text_title_case(spark):
    df = spark.createDataFrame([("  big  RED box ",)], "s string")
    assert ops.standardize_text(df, "s", case="title", spaces="collapse").collect()[0].s == "Big Red Box"
