import json
import math

from pyspark.sql import functions as F

from blockpipe import operators as ops


def test_profile_flags_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c")], "A double, B string")
    rows = ops.schema_profile(df).collect()
    assert [(r.column_name, r.data_type, r.has_nulls) for r in rows] == [
        ("A", "double", True),
        ("B", "string", False),
    ]


def test_profile_bigint_with_null_stays_bigint(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "A bigint")
    assert ops.schema_profile(df).collect()[0].asDict() == {
        "column_name": "A", "data_type": "bigint", "has_nulls": True}


def test_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert ops.schema_profile(df).collect()[0].has_nulls is True


def test_profile_sample_rows(spark):
    df = spark.range(100).select(F.when(F.col("id") == 99, None).otherwise(F.col("id")).alias("x"))
    df = df.coalesce(1)
    assert ops.schema_profile(df, sample_rows=10).collect()[0].has_nulls is False
    assert ops.schema_profile(df).collect()[0].has_nulls is True


def test_profile_empty_frame(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [r.has_nulls for r in ops.schema_profile(df).collect()] == [False, False]


def test_dataset_summary(spark):
    df1 = spark.createDataFrame([(1,), (2,), (3,)], "A bigint")
    df2 = spark.createDataFrame([(4,), (5,), (6,)], "B bigint")
    rows = ops.dataset_summary({"df1": df1, "df2": df2}).collect()
    assert [(r.dataset, r.column_name) for r in rows] == [("df1", "A"), ("df2", "B")]


def test_preview_orders_and_limits(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("k"))
    assert [r.k for r in ops.preview(df, 5, order_by=["k"]).collect()] == [0, 1, 2, 3, 4]
    assert ops.preview(df).count() == 10


def test_preview_records_json(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan"))], "a int, s string, x double"
    ).withColumn("t", F.lit("2024-01-01 00:00:07.179575").cast("timestamp_ntz"))
    rec = ops.preview_records({"d": df}).collect()[0]
    assert rec.dataset == "d"
    obj = json.loads(rec.record)
    assert obj == {"a": 1, "s": None, "x": None, "t": "2024-01-01T00:00:07.179"}


def test_preview_records_interval_as_seconds(spark):
    df = spark.sql("select make_dt_interval(0, 0, 1, 30.5) as d")
    obj = json.loads(ops.preview_records(df).collect()[0].record)
    assert math.isclose(obj["d"], 90.5)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2.0, "x")], "`a.b` int, `c d` double, `e``f` string")
    prof = [(r.column_name, r.has_nulls) for r in ops.schema_profile(df).collect()]
    assert prof == [("a.b", False), ("c d", True), ("e`f", False)]
    assert ops.drop_duplicates(df, ["a.b"], keep_by="c d").collect()[0]["c d"] == 2.0  # a missing value never wins
    assert ops.integrate([df, df], "a.b").count() == 1
    assert ops.recommend_cleaning({"t": df}).count() >= 1
    assert len(ops.preview_records(df).collect()) == 2


def test_preview_records_nested_types(spark):
    df = spark.sql(
        "select array(1, 2) as a, map('k', 1.5) as m, named_struct('x', 1, 'y', 'z') as s, "
        "cast(12.345 as decimal(10, 3)) as d, cast('hi' as binary) as b, date'2024-01-02' as day"
    )
    obj = json.loads(ops.preview_records(df).collect()[0].record)
    assert obj["a"] == [1, 2] and obj["m"] == {"k": 1.5} and obj["s"] == {"x": 1, "y": "z"}
    assert obj["d"] == 12.345 and obj["day"] == "2024-01-02T00:00:00.000"
    assert ops.schema_profile(df).count() == 6



def test_preview_records_as_one_array(spark):
    df = spark.range(30).select((29 - F.col("id")).alias("k"), F.lit(None).cast("string").alias("s"))
    row = ops.preview_records({"d": df}, 5, order_by=["k"], as_array=True).collect()
    assert [r.dataset for r in row] == ["d"]
    assert json.loads(row[0].records) == [{"k": i, "s": None} for i in range(5)]
