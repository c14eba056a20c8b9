"""Patterns and variants planted in text columns."""

import pytest

from blockpipe import operators as ops


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_spellings_and_initials_become_a_mapping(spark):
    planted = (
        ["United States of America"] * 5 + ["united states of america", "America, United States of", "  United  States of America!"]
        + ["USA"] * 3 + ["U.S.A.", "u s a", "United Kingdom", "United Kingdom", "UK", "Uk", "Uruguay", "it", None, "", "--"]
    )
    df = spark.createDataFrame([(i, v) for i, v in enumerate(planted)], "id int, `na.me` string")
    found = ops.value_variants(df, "na.me")
    us, uk = "United States of America", "United Kingdom"
    assert rows(found, "value", "target", "rule") == sorted([
        ("united states of america", us, "spelling"), ("America, United States of", us, "spelling"),
        ("  United  States of America!", us, "spelling"), ("USA", us, "initials"), ("U.S.A.", us, "initials"),
        ("u s a", us, "initials"), ("UK", uk, "initials"), ("Uk", uk, "initials"),
    ])
    assert {(r.value, r.n, r.target_n) for r in found.collect()} >= {("USA", 3, 5), ("UK", 1, 2)}
    mapped = ops.map_values(df, "na.me", found).groupBy("`na.me`").count().collect()
    assert {r[0]: r[1] for r in mapped} == {us: 13, uk: 4, "Uruguay": 1, "it": 1, None: 1, "": 1, "--": 1}


def test_initials_of_two_names_are_left_alone(spark):
    df = spark.createDataFrame([("New South Wales",), ("National Ski Week",), ("NSW",), ("nsw",)], "v string")
    assert rows(ops.value_variants(df, "v"), "value", "target", "rule") == [("nsw", "NSW", "spelling")]


def test_ordinary_words_are_no_initials(spark):
    df = spark.createDataFrame([("Icy Tea",), ("it",)], "v string")
    assert ops.value_variants(df, "v").count() == 0


def test_ties_and_groups(spark):
    data = [("a", "Bo ca"), ("a", "ca bo"), ("b", "ca bo"), ("b", "x"), (None, "BO-CA"), (None, "bo ca"), (None, "bo ca")]
    df = spark.createDataFrame(data, "g string, v string")
    found = ops.value_variants(df, "v", by="g")
    assert rows(found.where("g is not null"), "g", "value", "target") == [("a", "ca bo", "Bo ca")]
    assert rows(found.where("g is null"), "value", "target", "n") == [("BO-CA", "bo ca", 1)]
    assert {r.target for r in ops.value_variants(df, "v").collect()} == {"bo ca"}


def test_hot_variant_group_and_long_and_empty(spark):
    many = spark.range(4_000).selectExpr("concat('New York', repeat('.', cast(id % 2000 as int))) as v")
    found = ops.value_variants(many, "v")
    assert found.count() == 1_999 and {r.target for r in found.select("target").distinct().collect()} == {"New York"}
    assert ops.value_variants(many.where("false"), "v").collect() == []
    long = spark.createDataFrame([("word " * 50_000,), ("WORD",)], "v string")
    assert rows(ops.value_variants(long, "v"), "target") == [("WORD",)]


@pytest.mark.parametrize("cols", [["d.1", "w"], ["w", "d.1"]])
def test_patterns(spark, cols):
    data = [("2020-01-02", "Ab"), ("2021-11-12", "Éa"), ("1/2/2020", None), (None, "")]
    df = spark.createDataFrame(data, "`d.1` string, w string")
    got = rows(ops.value_patterns(df, cols), "column_name", "pattern", "n", "example")
    assert got == [("d.1", "9-9-9", 2, "2020-01-02"), ("d.1", "9/9/9", 1, "1/2/2020"), ("w", "", 1, ""), ("w", "Aa", 2, "Ab")]
    assert {r.share for r in ops.value_patterns(df, "w").collect()} == {1 / 3, 2 / 3}
    assert ops.value_patterns(df.where("false"), cols).collect() == []
