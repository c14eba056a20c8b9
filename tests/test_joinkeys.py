"""Join keys found by values, against plain sets."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops


def by_sets(dfs, kinds, min_containment, min_coverage):
    """The same pairs from sets of values on the driver."""
    held = {
        (d, c): [r[0] for r in df.select(F.col(f"`{c}`")).collect() if r[0] not in (None, "")]
        for d, df in dfs.items() for c in df.columns if (d, c) in kinds
    }
    found = set()
    for (x, y) in itertools.permutations(held, 2):
        a, b = set(held[x]), set(held[y])
        if x[0] == y[0] or kinds[x] != kinds[y] or not a or len(b) < len(held[y]):
            continue
        n = len(a & b)
        if b and n / len(a) >= min_containment and n / len(b) >= min_coverage:
            found.add((*x, *y, len(a), len(b), n, n / len(a), n / len(b)))
    return found


def test_inclusions_under_other_names_beyond_a_sketch(spark):
    users = spark.range(30_000).select((F.col("id") * 3).alias("key.id"), F.concat(F.lit("u"), "id").alias("name"))
    visits = spark.range(60_000).select(
        (F.col("id") % 20_000 * 3).cast("int").alias("who"),  # all are users
        (F.col("id") * 3 + 1).alias("disjoint"),
        F.when(F.col("id") % 50 == 0, -F.col("id") - 1).otherwise(F.col("id") % 9_000 * 3).alias("dirty"),
        F.concat(F.lit("u"), (F.col("id") % 40_000)).alias("label"),
        F.lit(1.5).alias("amount"),
    )
    dfs = {"users": users, "visits": visits}
    kinds = {("users", "key.id"): "i", ("users", "name"): "t", ("visits", "who"): "i", ("visits", "disjoint"): "i",
             ("visits", "dirty"): "i", ("visits", "label"): "t"}
    for containment, coverage in ((0.95, 0.1), (0.7, 0.0)):
        got = {tuple(r) for r in ops.suggest_joins(dfs, containment, coverage).collect()}
        assert got == by_sets(dfs, kinds, containment, coverage)
    strict = {(r.left_column, r.right_column) for r in ops.suggest_joins(dfs).collect()}
    assert strict == {("who", "key.id")}


def test_few_values_against_many(spark):
    """A sketch of many values can't hold a few given ones: the pair is still judged exactly."""
    many = spark.range(200_000).select(F.col("id").alias("key"))
    few = spark.createDataFrame([(i * 9_000,) for i in range(20)], "v long")
    got = ops.suggest_joins({"many": many, "few": few}, min_coverage=0.0).collect()
    assert [tuple(r) for r in got] == [("few", "v", "many", "key", 20, 200_000, 20, 1.0, 0.0001)]


def test_kinds_nulls_repeats_and_empty_tables(spark):
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(1, "x", day, "1"), (2, "", day + dt.timedelta(1), "2"), (None, None, None, None)],
                              "n int, t string, d date, digits string")
    b = spark.createDataFrame([(1, "x", day), (2, "y", day + dt.timedelta(1)), (2, "y", day)], "m long, s string, e date")
    got = {(r.left_dataset, r.left_column, r.right_column) for r in ops.suggest_joins({"a": a, "b": b}).collect()}
    # b's values repeat, so only a's columns are keys; a number is no text
    assert got == {("b", "m", "n"), ("b", "e", "d")}
    nothing = {"a": a.limit(0), "b": b}
    assert ops.suggest_joins(nothing).count() == 0
    assert ops.suggest_joins({"a": a}).count() == 0
    with pytest.raises(ValueError):
        ops.suggest_joins({"a": a, "b": b}, min_containment=0)
