"""Mutual information against numpy, and the choice by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops


@pytest.fixture(scope="module")
def table(spark):
    """y = (x - 0.5)^2 has no linear correlation with x."""
    df = spark.range(20_000).select("id", F.rand(1).alias("x.1"), F.rand(2).alias("noise"), F.rand(3).alias("weak"))
    df = df.withColumn("y", F.pow(F.col("`x.1`") - 0.5, 2) + F.col("weak") / 50).withColumn("copy", 7 - 3 * F.col("`x.1`"))
    return df.withColumn("fixed", F.lit(4)).cache()


def test_equal_to_numpy(table):
    rows = table.select("`x.1`", "y", "noise").toPandas()
    binned = {c: np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 10), 9) for c, v in rows.items()}
    got = {(r.a, r.b): r.information for r in ops.mutual_information(table, ["x.1", "y", "noise"], bins=10).collect()}
    assert len(got) == 6
    for (a, b), found in got.items():
        n, _, _ = np.histogram2d(binned[a], binned[b], bins=10, range=[[-0.5, 9.5]] * 2)
        p = n / n.sum()
        lift = p / np.outer(p.sum(1), p.sum(0)).clip(1e-300)
        assert np.isclose(found, (p[p > 0] * np.log(lift[p > 0])).sum(), atol=1e-9)


def test_copies_are_chosen_once(table):
    features = ["noise", "copy", "fixed", "weak", "x.1"]
    _, one = ops.select_informative(table, features, "y", top_k=1)
    assert one.columns == ["copy", "y"]  # as good as x.1, and earlier
    _, more = ops.select_informative(table, features, "y", top_k=5, keep=["id"])
    assert more.columns == ["id", "noise", "copy", "weak", "y"]
    scores = {r.feature: abs(r["corr"]) for r in ops.feature_scores(table, ["copy"], "y").collect()}
    assert scores["copy"] < 0.05  # by linear correlation it would not have been found


def test_missing_infinite_text_and_empty(spark):
    inf = float("inf")
    data = [(None, "a", 1.0), (inf, "b", 2.0), (-inf, "c", 3.0), (float("nan"), "a", 1.0), (0.0, None, 4.0), (9.0, "e", 5.0)]
    df = spark.createDataFrame(data, "v double, t string, y double")
    got = {(r.a, r.b): r.information for r in ops.mutual_information(df, ["v", "t", "y"], bins=16).collect()}
    # five different bins of v (missing twice): -2/6 ln 2/6 - 4/6 ln 1/6, and y follows from it
    entropy = -(2 / 6 * np.log(2 / 6) + 4 / 6 * np.log(1 / 6))
    assert np.isclose(got["v", "v"], entropy) and np.isclose(got["v", "y"], entropy)
    assert ops.mutual_information(df.where("false"), ["v", "t"]).collect() == []
    assert ops.select_informative(df.where("false"), ["v", "t"], "y", 2)[1].columns == ["y"]
    with pytest.raises(ValueError):
        ops.mutual_information(df, ["v", "v"])


def test_pca_plans_agree(spark, monkeypatch):
    from blockpipe.operators import transform

    df = spark.range(500).select("id", F.rand(1).alias("a"), (F.rand(2) * 3).alias("b.x"), F.when(F.col("id") > 4, F.rand(3) + F.rand(1)).alias("c"))
    df = spark.createDataFrame(df.toArrow())
    plain = [r.pca for r in ops.extract_features(df, ["a", "b.x", "c"], "pca", k=2).orderBy("id").collect()]
    monkeypatch.setattr(transform, "PCA_PLAIN_COLS", 0)
    wide = [r.pca for r in ops.extract_features(df, ["a", "b.x", "c"], "pca", k=2).orderBy("id").collect()]
    assert plain[:5] == wide[:5] == [[None, None]] * 5
    assert np.allclose(plain[5:], wide[5:], atol=1e-9)
