from blockpipe import operators as ops


def test_clean_data_has_no_cleaning_suggestions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    assert ops.recommend_cleaning({"t": df}).count() == 0


def test_cleaning_rules_and_limit(spark):
    rows = [(1, " a", "1.5", float("nan")), (1, " a", "1.5", float("nan")), (2, "b", "2", 3.0)]
    df = spark.createDataFrame(rows, "k int, s string, n string, x double")
    got = [(r.rank, r.column_name, r.technique, r.affected_rows) for r in ops.recommend_cleaning({"t": df}).collect()]
    assert got == [
        (1, "n", "correct_types", 3),
        (2, "s", "standardize_text", 2),
        (3, "x", "impute", 2),
        (4, "*", "drop_duplicates", 1),
    ]
    assert ops.recommend_cleaning({"t": df}, limit=2).count() == 2


def test_transformation_rules(spark):
    a = spark.sql("select 'Dr Ann Lee' as full_name, timestamp_ntz'2024-01-01 00:00:00' as t, 1.5d as x, 1L as id")
    b = spark.sql("select 2L as id, 'x' as other")
    got = [(r.technique, r.dataset, r.column_name) for r in ops.recommend_transformations({"a": a, "b": b}).collect()]
    assert got == [
        ("split_column", "a", "full_name"),
        ("construct", "a", "t"),
        ("discretize", "a", "x"),
        ("join_on_keys", "a, b", "id"),
    ]
    c = spark.sql("select 3L as other_id, 'y' as other").selectExpr("other_id as id", "other")
    assert [r.technique for r in ops.recommend_transformations({"b": b, "c": c}).collect()] == ["join_on_keys", "union"]


def test_cleaning_with_a_map_column(spark):
    df = spark.sql("select map('k', 1) as m, cast(null as string) as s union all select map('k', 2), 'x'")
    got = {(r.column_name, r.technique) for r in ops.recommend_cleaning({"t": df}).collect()}
    assert got == {("s", "impute")}  # no duplicate rule: rows with maps cannot be grouped


def test_repeated_rows_by_nulls_nesting_and_signs(spark):
    """Only rows that are equal in every column, nulls and nested nulls too, repeat."""
    rows = [
        (None, 1, "a", "", [None, 1], {"x": 1, "y": 2}, 0.0),
        (1, None, "a", "", [None, 1], {"x": 1, "y": 2}, 0.0),
        (1, None, "", "a", [None, 1], {"x": 1, "y": 2}, 0.0),
        (1, None, "", "a", [1, None], {"x": 1, "y": 2}, 0.0),
        (1, None, "", "a", [], {"x": 1, "y": 2}, 0.0),
        (1, None, "", "a", None, {"x": 1, "y": 2}, 0.0),
        (1, None, "", None, None, {"x": 1, "y": 2}, 0.0),
        (1, None, "", None, None, {"y": 2, "x": 1}, -0.0),  # equals the one before
        (1, None, "", None, None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "i int, j int, s string, t string, a array<int>, m map<string,int>, `d.d` double")
    got = ops.recommend_cleaning({"rows": df}, limit=50).where("technique = 'drop_duplicates'").collect()
    assert [r.affected_rows for r in got] == [1]
    assert ops.recommend_cleaning({"rows": df.limit(6)}, limit=50).where("technique = 'drop_duplicates'").count() == 0
