import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from blockpipe import sources as io


def test_snapshot_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "A bigint, B string")
    io.save_snapshot({"result": df}, tmp_dir)
    back = io.load_snapshot(spark, tmp_dir)
    assert list(back) == ["result"]
    assert sorted(back["result"].collect()) == sorted(df.collect())
    assert back["result"].schema == df.schema


def test_snapshot_two_datasets_and_replace(spark, tmp_dir):
    df1 = spark.createDataFrame([(1,), (2,), (3,)], "A bigint")
    df2 = spark.createDataFrame([(4,), (5,), (6,)], "B bigint")
    io.save_snapshot({"df1": df1, "df2": df2}, tmp_dir)
    back = io.load_snapshot(spark, tmp_dir)
    assert sorted(back) == ["df1", "df2"] and back["df2"].count() == 3
    io.save_snapshot({"only": df1}, tmp_dir)
    assert list(io.load_snapshot(spark, tmp_dir)) == ["only"]


def test_missing_snapshot_is_empty(spark, tmp_dir):
    assert io.load_snapshot(spark, os.path.join(tmp_dir, "nothing")) == {}


def test_read_tables_keys_skip_and_collision(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/one.parquet")
    spark.range(4).write.parquet(f"{tmp_dir}/two.parquet")
    out = io.read_tables(spark, [f"{tmp_dir}/one.parquet", f"{tmp_dir}/two.parquet", f"{tmp_dir}/gone.parquet"], fmt="parquet")
    assert {k: v.count() for k, v in out.items()} == {"one": 3, "two": 4}
    assert io.read_table(spark, None, "parquet", path=f"{tmp_dir}/one.parquet").count() == 3
    os.makedirs(f"{tmp_dir}/x", exist_ok=True)
    spark.range(5).write.parquet(f"{tmp_dir}/x/one.parquet")
    names = [f"{tmp_dir}/one.parquet", f"{tmp_dir}/x/one.parquet"]
    with pytest.raises(ValueError):
        io.read_tables(spark, names, fmt="parquet")
    assert io.read_tables(spark, names, fmt="parquet", on_collision="last")["one"].count() == 5
    assert io.dataset_key("proj.dataset.table") == "table"


def test_normalize_dates(spark):
    df = spark.sql("select date'2024-02-03' as d, 1 as x, time'12:34:56.5' as t")
    out = io.normalize_dates(df)
    assert dict(out.dtypes)["d"] == "timestamp_ntz"
    assert dict(out.dtypes)["t"] == "interval day to second"
    row = out.collect()[0]
    assert row.d == dt.datetime(2024, 2, 3)
    assert row.t == dt.timedelta(hours=12, minutes=34, seconds=56.5)


def test_csv_convert_and_export(spark, tmp_dir):
    df = spark.createDataFrame(
        [(1, 'say "hi"', None), (2, "", 1.5)], "id int, s string, x double"
    ).withColumn("t", F.lit("2024-01-01 00:00:07.179575").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_dir}/src")
    back = io.convert_files(spark, f"{tmp_dir}/src", "parquet", f"{tmp_dir}/csv", "csv")
    assert sorted(back.collect()) == sorted(df.collect())
    path = io.export_csv(df, f"{tmp_dir}/export")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/*.csv")))
    assert '"say ""hi"""' in text
    assert '2,"",1.5,' in text and '1,"say ""hi""",,' in text
    again = io.read_export(spark, path, df.schema)
    assert sorted(again.collect()) == sorted(df.collect())


def test_move_table_and_files(spark, tmp_dir):
    df = spark.range(5).withColumn("sq", F.col("id") * F.col("id"))
    t = io.move(spark, df, "moved_table")
    assert t.count() == 5
    f = io.move(spark, "moved_table", f"{tmp_dir}/json", destination_fmt="json")
    assert sorted(r.sq for r in f.collect()) == [0, 1, 4, 9, 16]
    p = io.move(spark, f"{tmp_dir}/json", f"{tmp_dir}/pq", source_fmt="json", destination_fmt="parquet")
    assert p.count() == 5


def test_export_empty_dataset(spark, tmp_dir):
    df = spark.createDataFrame([], "a int, b string")
    path = io.export_csv(df, f"{tmp_dir}/empty")
    assert io.read_export(spark, path, df.schema).count() == 0


def test_bucketed_tables_join_without_shuffle(spark):
    from blockpipe import operators as ops

    orders = spark.range(1000).selectExpr("id as k", "id * 2 as amount")
    lines = spark.range(4000).selectExpr("id % 1000 as k", "id as line")
    io.write_table(orders, "b_orders", bucket_by=(8, ["k"]), sort_by=["k"])
    io.move(spark, lines, "b_lines", bucket_by=(8, ["k"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ops.join_on_keys(spark.table("b_orders"), spark.table("b_lines"), "k")
        assert joined.count() == 4000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_convert_partitioned_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "en", 1.5), (2, "de", None), (3, "en", 2.0)], "id int, lang string, x double")
    df.write.json(f"{tmp_dir}/src")
    back = io.convert_files(spark, f"{tmp_dir}/src", "json", f"{tmp_dir}/dst", "parquet",
                            partition_by=["lang"], schema=df.schema)
    assert back.columns == df.columns
    assert sorted(back.collect()) == sorted(df.collect())
    assert {"lang=de", "lang=en"} <= set(os.listdir(f"{tmp_dir}/dst"))


def test_partitioned_table_write_and_move(spark):
    df = spark.createDataFrame([(1, "en"), (2, "de"), (3, "en")], "id int, lang string")
    io.write_table(df, "by_lang", partition_by=["lang"])
    assert sorted(r.id for r in spark.table("by_lang").where("lang = 'en'").collect()) == [1, 3]
    moved = io.move(spark, "by_lang", "by_lang_copy", partition_by=["lang"])
    assert moved.count() == 3
    plan = moved.where("lang = 'de'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan  # the partition folders are pruned
