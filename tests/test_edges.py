"""Empty inputs and null keys: every operator still plans and runs."""

import pytest

from blockpipe import operators as ops
from blockpipe.plans import block_adjacency, quantiles, rank_within
from blockpipe.plans.lineage import BLOCKS_DDL

DDL = "id bigint, g string, v double, t bigint, s string"


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture()
def nullkeys(spark):
    rows = [(1, None, 1.0, 1, "a b"), (2, None, None, 2, "c d"), (3, None, 3.0, 3, None), (4, "x", 4.0, 1, "e f")]
    return spark.createDataFrame(rows, DDL)


CASES = {
    "schema_profile": lambda df: ops.schema_profile(df),
    "preview_records": lambda df: ops.preview_records(df, order_by=["id"]),
    "drop_missing": lambda df: ops.drop_missing(df),
    "drop_duplicates": lambda df: ops.drop_duplicates(df, ["g"], keep_by="id"),
    "impute_mean": lambda df: ops.impute(df, "v", "mean"),
    "impute_median_by": lambda df: ops.impute(df, "v", "median", by="g"),
    "impute_mode_by": lambda df: ops.impute(df, "s", "mode", by="g"),
    "standardize_text": lambda df: ops.standardize_text(df, "s"),
    "map_values": lambda df: ops.map_values(df, "s", {"a b": "ab"}),
    "split_column": lambda df: ops.split_column(df, "s", ["p", "q"]),
    "smooth": lambda df: ops.smooth(df, "v", "g", ["t", "id"], 2),
    "smooth_ranked": lambda df: ops.smooth(df, "v", "g", ["t", "id"], 2, method="ranked"),
    "drop_outliers_iqr": lambda df: ops.drop_outliers(df, "v"),
    "drop_outliers_z": lambda df: ops.drop_outliers(df, "v", "zscore"),
    "discretize_width": lambda df: ops.discretize(df, "v"),
    "discretize_quantile": lambda df: ops.discretize(df, "v", "quantile", n=4),
    "reduce_rows": lambda df: ops.reduce_rows(df, 0.5, "id"),
    "feature_scores": lambda df: ops.feature_scores(df, ["v", "t"], "id"),
    "scale": lambda df: ops.extract_features(df, ["v"], "scale"),
    "integrate": lambda df: ops.integrate([df, df], "id", on_duplicate="merge"),
    "union": lambda df: ops.union([df, df], distinct=True),
    "band_join": lambda df: ops.join_on_condition(
        df.alias("a"), df.alias("b"), "a.v < b.v and b.v < a.v + 2", band=("a.v", "b.v", 0, 2)
    ),
    "recommend_cleaning": lambda df: ops.recommend_cleaning({"d": df}),
    "recommend_transformations": lambda df: ops.recommend_transformations({"d": df}),
    "quantiles": lambda df: quantiles(df, "v", [0.5], by=["g"]),
    "quantiles_ranked": lambda df: quantiles(df, "v", [0.5], by=["g"], method="ranked"),
    "impute_median_ranked": lambda df: ops.impute(df, "v", "median", by="g", quantile_method="ranked"),
    "rank_within": lambda df: rank_within(df, ["g"], ["t", "id"]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_empty_input(empty, name):
    assert CASES[name](empty).count() >= 0


@pytest.mark.parametrize("name", list(CASES))
def test_null_keys(nullkeys, name):
    assert CASES[name](nullkeys).count() >= 0


@pytest.mark.parametrize("method", ["ranked", "auto"])
def test_null_group_is_a_group(nullkeys, method):
    qmethod = "ranked" if method == "ranked" else "percentile"
    med = {r.g: r.q0 for r in quantiles(nullkeys, "v", [0.5], by=["g"], method=qmethod).collect()}
    assert med == {None: 2.0, "x": 4.0}
    pos = {r.id: r._pos for r in rank_within(nullkeys, ["g"], ["t", "id"]).collect()}
    assert pos == {1: 0, 2: 1, 3: 2, 4: 0}
    sm = {r.id: r.v for r in ops.smooth(nullkeys, "v", "g", ["t", "id"], 2, method=method).collect()}
    assert sm == {1: 1.0, 2: 1.0, 3: 3.0, 4: 4.0}


def test_empty_block_table(spark):
    assert block_adjacency(spark.createDataFrame([], BLOCKS_DDL)).count() == 0


def test_columns_named_like_helpers(spark):
    """User columns called count / _pos do not clash with internal names."""
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, "b", None)], "count int, g string, v double")
    assert ops.recommend_cleaning({"t": df}).where("technique = 'drop_duplicates'").first().affected_rows == 1
    assert ops.integrate([df.dropDuplicates()], "g", on_duplicate="error").count() == 2
    assert quantiles(df, "v", [0.5], by=["count"]).count() == 1
    assert ops.smooth(df, "v", "count", ["g"], 2).count() == 3
