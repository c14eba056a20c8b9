"""Results that must not depend on size, session zone, file format or plan."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe import sources as io
from blockpipe.plans import ModelError, pandas_block, run_model
from blockpipe.plans.ranking import quantiles, rank_within
from blockpipe.plans.sizing import broadcast_if_small

TEXTS = [
    "  lead", "trail  ", "a\r\nb", "a\rb", "a\nb", "\n", "\r", "back\\slash", 'q"uo""te', "\\", '"', "", None, ",",
    " ", "\t", "\u00e9\u3000", 'a,b\\"', '\\",x', "#c", "null", "NaN",
]


def test_csv_keeps_every_text(spark, tmp_dir):
    rows = [(t, i) for i, t in enumerate(TEXTS)]
    two = spark.createDataFrame(rows, "t string, i int")
    one = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for name, df in (("two", two), ("one", one)):
        back = io.read_export(spark, io.export_csv(df, f"{tmp_dir}/{name}"), df.schema)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
        moved = io.move(spark, df, f"{tmp_dir}/{name}_moved", destination_fmt="csv")
        assert sorted(map(repr, moved.collect())) == sorted(map(repr, df.collect()))
    numbers = spark.createDataFrame([(1,), (None,)], "i int")
    back = io.read_export(spark, io.export_csv(numbers, f"{tmp_dir}/n"), numbers.schema)
    assert sorted(map(repr, back.collect())) == ["Row(i=1)", "Row(i=None)"]


def test_saving_nothing_empties_the_snapshot(spark, tmp_dir):
    io.save_snapshot({"a": spark.range(3)}, tmp_dir)
    io.save_snapshot({}, tmp_dir)
    assert io.load_snapshot(spark, tmp_dir) == {}
    io.save_snapshot({"b": spark.range(2)}, tmp_dir)
    assert list(io.load_snapshot(spark, tmp_dir)) == ["b"]


@pytest.mark.parametrize("extra", [0, 20_000])
def test_value_mapping_is_alike_at_any_size(spark, extra):
    df = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "s string")
    mapping = {"a": 1, "b": 2, None: 3, **{f"x{i}": i for i in range(extra)}}
    assert sorted(str(r.s) for r in ops.map_values(df, "s", mapping).collect()) == ["1", "2", "None", "zz"]


def test_value_with_two_targets_is_an_error(spark):
    df = spark.createDataFrame([("1",)], "s string")
    with pytest.raises(ValueError):
        ops.map_values(df, "s", {1: "a", "1": "b"})
    table = spark.createDataFrame([("1", "a"), ("1", "b")], "f string, t string")
    with pytest.raises(Exception, match="several targets"):
        ops.map_values(df, "s", table).collect()


def test_smoothing_has_one_type_and_result_in_both_plans(spark):
    df = spark.range(200).selectExpr(
        "id", "id % 3 as k", "cast(id % 7 as int) as t", "cast(id * 1.37 as decimal(20,2)) as d", "cast(id as int) as n"
    )
    for col in ("d", "n"):
        small = ops.smooth(df, col, "k", "t", 4, out="m", max_group_rows=1000)
        large = ops.smooth(df, col, "k", "t", 4, out="m", max_group_rows=10, chunk_rows=8)
        assert small.schema["m"].dataType == large.schema["m"].dataType
        a, b = ({r.id: r.m for r in x.collect()} for x in (small, large))
        assert a == pytest.approx(b)  # tied orders included


def test_quantile_methods_agree_on_values_at_the_edges(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x),) for x in rng.integers(0, 12, 3001) / 10], "v double")
    probs = [0.1, 0.25, 1 / 3, 0.5, 0.9]
    a = quantiles(df, "v", probs, max_group_rows=10_000).collect()
    b = quantiles(df, "v", probs, max_group_rows=10).collect()
    assert a == b
    one = ops.discretize(df, "v", "quantile", n=7, quantile_method="percentile").groupBy("bin").count().collect()
    two = ops.discretize(df, "v", "quantile", n=7, quantile_method="ranked").groupBy("bin").count().collect()
    assert sorted(one) == sorted(two)


def test_tied_orders_are_cut_into_many_partitions(spark):
    df = spark.range(40_000).selectExpr("1 as k", "7 as t", "id % 5 as v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = rank_within(df, ["k"], ["t"])
        sizes = [len(p) for p in ranked.select("_pos").rdd.glom().collect()]
        assert max(sizes) < 40_000 / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r[0] for r in ranked.select("_pos").collect()) == list(range(40_000))


def test_whole_groups_of_any_size_reach_pandas(spark):
    df = spark.range(300).selectExpr("id", "id % 2 as g")
    assert pandas_block(df, lambda pdf: pdf, "id bigint, g bigint", keys=["g"]).count() == 300


def test_split_keeps_what_is_left_over(spark):
    df = spark.createDataFrame([("a b c d",)], "s string")
    assert ops.split_column(df, "s", ["x", "y"]).select("x", "y").first() == ("a", "b c d")
    assert ops.split_column(df, "s", ["x", "y"], keep_rest=False).select("x", "y").first() == ("a", "b")


def test_recommendations_for_map_and_variant_columns(spark):
    df = spark.sql(
        "select map('a', 1, 'b', 2) as m, parse_json('{\"k\": 1}') as j, 'x' as s "
        "union all select map('b', 2, 'a', 1), parse_json('{\"k\": 1}'), 'x' "
        "union all select map('b', 3), parse_json('{\"k\": 1}'), 'x'"
    )
    got = {(r.technique, r.affected_rows) for r in ops.recommend_cleaning({"d": df}).collect()}
    assert ("drop_duplicates", 1) in got


def test_each_dataset_is_scanned_once_for_transformations(spark, tmp_dir):
    dfs = {}
    for n in range(4):
        spark.range(5).selectExpr("id", "cast(id as double) as v").write.parquet(f"{tmp_dir}/{n}")
        dfs[f"d{n}"] = spark.read.parquet(f"{tmp_dir}/{n}")
    from tests.plan_report import final_plan

    out = ops.recommend_transformations(dfs, limit=50)
    assert len(out.collect()) == 4 + 2 * 6
    assert final_plan(out).count("FileScan") == 4
    clean = ops.recommend_cleaning(dfs)
    clean.collect()
    assert final_plan(clean).count("FileScan") <= 8


def test_long_keys_are_not_broadcast(spark):
    long = spark.range(2000).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 20_000)).alias("k"))
    assert broadcast_if_small(long)[1] is False
    assert broadcast_if_small(spark.range(2000))[1] is True


def test_whole_numbers_are_not_filled_with_fractions(spark):
    df = spark.createDataFrame([(1,), (None,)], "i int")
    with pytest.raises(ValueError):
        ops.impute(df, "i", "constant", value=0.5)
    assert sorted(r.i for r in ops.impute(df, "i", "constant", value=2.0).collect()) == [1, 2]


def test_blanks_of_any_script_are_standardized(spark):
    df = spark.createDataFrame([("\u3000a\u3000 b\u00a0",)], "s string")
    assert ops.standardize_text(df, "s", case=None, spaces="collapse").first().s == "a b"
    assert ops.standardize_text(df, "s", case=None).first().s == "ab"


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_parsed_times_do_not_follow_the_session(spark, zone):
    rows = [("2024-03-10 02:30:00", "10/03/2024 02:30"), ("2024-03-10T02:30:00.25+02:00", "nope"), ("2024-03-10", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = ops.parse_time(ops.parse_time(df, "a"), "b", "dd/MM/yyyy HH:mm").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    t = dt.datetime(2024, 3, 10, 2, 30)
    assert [tuple(r) for r in got] == [(t, t), (dt.datetime(2024, 3, 10, 0, 30, 0, 250000), None), (dt.datetime(2024, 3, 10), None)]


def test_pca_of_many_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 200)) + 0.01 * rng.normal(size=(400, 200))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"c{i}" for i in range(200)]])
    got = ops.extract_features(df, [f"c{i}" for i in range(200)], "pca", k=3).orderBy("id").collect()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([r.pca for r in got]), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_model_braces_and_sources(spark):
    o = spark.createDataFrame([(1, '{"a": 2}')], "id int, j string")
    sql = "select id, j = '{\"a\": 2}' as same, from_json(j, 'a int').a as a, '{x}' as x from {o}"
    assert run_model(spark, "braces", sql, {"o": o}).collect()[0] == (1, True, 2, "{x}")
    with pytest.raises(ModelError):
        run_model(spark, "broken", "select nothing_here from {o}", {"o": o})
    spark.sql("create database if not exists main")
    o.write.mode("overwrite").saveAsTable("main.one_arg")
    assert run_model(spark, "short", "select id from {{ source('one_arg') }}").count() == 1
    run_model(spark, "published", "select id from {{ source('main', 'one_arg') }}", materialized="table")
    assert spark.table("main.published").count() == 1


def test_source_descriptions_reach_the_model(spark):
    o = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    run_model(
        spark, "described", "select a, b, c + 1 as d from {o}", {"o": o}, materialized="table", schema="described_db",
        comments={"b": "own"}, source_comments={"o": {"a": "from the source", "b": "hidden", "c": "gone"}},
    )
    notes = {r.col_name: r.comment for r in spark.sql("describe described_db.described").collect()}
    assert notes == {"a": "from the source", "b": "own", "d": None}


def test_mode_of_several_columns_reads_the_input_twice(spark, tmp_dir):
    spark.createDataFrame([(1, "a", None), (1, None, 2), (None, "a", 2)], "x int, y string, z int").write.parquet(f"{tmp_dir}/p")
    from tests.plan_report import final_plan

    out = ops.impute(spark.read.parquet(f"{tmp_dir}/p"), ["x", "y", "z"], "mode")
    assert {tuple(r) for r in out.collect()} == {(1, "a", 2)}
    assert final_plan(out).count("FileScan") <= 4
