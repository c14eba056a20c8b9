"""Components by block power iteration against numpy's exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe.operators import widepca


def made(spark, rows, cols, rank, seed=3):
    rng = np.random.default_rng(seed)
    factors = rng.standard_normal((rows, rank)) * (2.0 ** -np.arange(rank)) * 8
    x = factors @ rng.standard_normal((rank, cols)) / np.sqrt(cols) + 0.01 * rng.standard_normal((rows, cols)) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>").repartition(4)
    return x, df.select("id", *[F.col("x")[j].alias(f"c{j}") for j in range(cols)])


def exact(x, k):
    centred = x - x.mean(axis=0)
    comps = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    for j in range(k):
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] = -comps[:, j]
    return centred @ comps


def scores(df, cols, k, **how):
    got = ops.extract_features(df, [f"c{j}" for j in range(cols)], "pca", k=k, **how).select("id", "pca")
    return {r["id"]: r["pca"] for r in got.collect()}


def test_block_equals_exact_components(spark):
    x, df = made(spark, 400, 60, 6)
    got = scores(df, 60, 4, solver="block")
    assert np.allclose([got[i] for i in range(len(x))], exact(x, 4), atol=1e-6)
    square = scores(df, 60, 4, solver="square")
    assert np.allclose([got[i] for i in range(len(x))], [square[i] for i in range(len(x))], atol=1e-6)


def test_wide_table_takes_the_block_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(widepca, "BLOCK_VALUES", 50_000)
    cols = 1_100  # beyond PCA_SQUARE_COLS
    x, df = made(spark, 120, cols, 4)
    got = scores(df, cols, 3)
    assert np.allclose([got[i] for i in range(len(x))], exact(x, 3), atol=1e-6)


def test_missing_values_and_empty_tables(spark):
    rows = [(1, 1.0, 2.0), (2, 2.0, 4.5), (3, None, 1.0), (4, float("nan"), 1.0), (5, 4.0, 7.0)]
    df = spark.createDataFrame(rows, "id int, c0 double, c1 double")
    got = scores(df, 2, 1, solver="block")
    assert got[3] == got[4] == [None]
    plain = scores(df, 2, 1)
    assert np.allclose([got[i] for i in (1, 2, 5)], [plain[i] for i in (1, 2, 5)])
    assert scores(df.where("id = 3"), 2, 1, solver="block") == {3: None}
    assert scores(df.limit(0), 2, 1, solver="block") == {}
    constant = spark.createDataFrame([(i, 1.0, 3.0) for i in range(4)], "id int, c0 double, c1 double")
    assert all(abs(v[0]) < 1e-12 for v in scores(constant, 2, 1, solver="block").values())
    with pytest.raises(ValueError):
        scores(df, 2, 1, solver="exact")
