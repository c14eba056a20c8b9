"""Samples of an exact size against plain Python over the same keys."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops


def uniform(seed, *key):
    text = "|".join([str(seed), *["" if k is None else str(k) for k in key]])
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def plain(rows, k, seed, weight=lambda r: None):
    """``rows`` of one stratum: {id: what it stands for}."""
    rows = [r for r in rows if weight(r) is None or (0 < weight(r) < math.inf)]
    order = sorted(rows, key=lambda r: uniform(seed, r.id) if weight(r) is None else -math.log(uniform(seed, r.id)) / weight(r))
    if len(order) <= k:
        return {r.id: 1.0 for r in order}
    if weight(order[0]) is None:
        return {r.id: len(order) / k for r in order[:k]}
    t = -math.log(uniform(seed, order[k].id)) / weight(order[k])
    return {r.id: -1 / math.expm1(-weight(r) * t) for r in order[:k]}


@pytest.fixture(scope="module")
def table(spark):
    """Stratum 0 has two thirds of the rows; null is a stratum; some weights are no weights."""
    s = F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 5 > 0, F.col("id") % 12)
    w = F.when(F.col("id") % 19 == 0, None).when(F.col("id") % 23 == 0, 0.0).when(F.col("id") % 29 == 0, float("nan"))
    w = w.when(F.col("id") % 31 == 0, float("inf")).when(F.col("id") % 37 == 0, -1.0).otherwise(F.col("id") % 100 + 0.5)
    return spark.range(3_000).select("id", s.alias("s.1"), w.alias("w")).cache()


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("strata", [[], ["s.1"]])
@pytest.mark.parametrize("k", [1, 40, 5_000])
def test_equal_to_plain_choice(table, weight, strata, k):
    rows = table.collect()
    got = ops.sample_rows(table.repartition(7), k, "id", strata, weight, seed=4)
    assert got.columns == ["id", "s.1", "w", "inclusion_weight"]
    want = {}
    for s in {r["s.1"] for r in rows} if strata else [None]:
        mine = [r for r in rows if not strata or r["s.1"] == s]
        want |= plain(mine, k, 4, (lambda r: -1 if r.w is None else r.w) if weight else lambda r: None)
    found = {r.id: r.inclusion_weight for r in got.collect()}
    assert got.count() == len(found) and found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-9) for i in want)


def test_a_size_for_each_stratum(table):
    got = ops.sample_rows(table, {0: 7, 3: 2}, "id", "s.1")
    assert {r["s.1"]: r["count"] for r in got.groupBy(F.col("`s.1`")).count().collect()} == {0: 7, 3: 2}


def test_weighted_sums_are_unbiased(spark):
    """400 samples at once, one a stratum: the mean estimate comes near the true sum."""
    df = spark.range(400).crossJoin(spark.range(50).toDF("i")).select(F.col("id").alias("s"), "i", F.pow(1.1, "i").alias("w"))
    df = df.withColumn("v", F.col("w") * (1 + F.col("i") % 3))
    true = sum(1.1**i * (1 + i % 3) for i in range(50))
    for weight in ("w", None):
        got = ops.sample_rows(df, 10, ["s", "i"], "s", weight, seed=1)
        sums = [r[0] for r in got.groupBy("s").agg(F.sum(F.col("v") * F.col("inclusion_weight"))).select(F.col("sum((v * inclusion_weight))")).collect()]
        mean = sum(sums) / 400
        error = (sum((x - mean) ** 2 for x in sums) / 400) ** 0.5 / 20
        assert len(sums) == 400 and abs(mean - true) < 4 * error
        assert error < true * (0.02 if weight else 0.05)


def test_equal_rows_and_equal_keys_keep_the_size_exact(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("v"))
    for k in (1, 3, 499, 500, 600):
        assert ops.sample_rows(df, k, "k").count() == min(k, 500)


def test_no_rows_and_refusals(spark, table):
    none = spark.createDataFrame([], "id int, s int, inclusion_weight double")
    assert ops.sample_rows(none, 3, "id", out="x").count() == 0
    assert ops.sample_rows(none, 3, "id", "s", out="x").columns == ["id", "s", "inclusion_weight", "x"]
    assert ops.sample_rows(none, 3, "id", "s", "inclusion_weight", out="x").count() == 0
    assert ops.sample_rows(none, 3, "id", weight="inclusion_weight", out="x").count() == 0
    for call in (lambda: ops.sample_rows(none, 3, "id"), lambda: ops.sample_rows(table, 0, "id"), lambda: ops.sample_rows(table, {1: 2}, "id")):
        with pytest.raises(ValueError):
            call()


def test_only_a_small_part_is_ranked(spark):
    from blockpipe.operators import sampling

    p = F.rand(5)
    rows = spark.range(300_000).select(p.alias("_bp_p"), F.col("id").alias("_bp_h"), F.lit(100_000).cast("bigint").alias("_bp_k"))
    rows = rows.withColumn("_bp_bin", F.floor(F.log2("_bp_p") * 1024).cast("int")).cache()
    last, single = sampling._last_bins(rows, [])
    assert sampling._edge(rows, last, [], single).count() < 500
