"""DataFrame-in, DataFrame-out blocks: profile (B), cleaning (C),
single-dataset transformations (D) and multi-dataset combinations (E)."""

from blockpipe.operators.clean import (
    correct_types,
    drop_duplicates,
    drop_missing,
    impute,
    map_values,
    standardize_names,
    standardize_text,
    standardize_values,
    standardized_names,
)
from blockpipe.operators.combine import (
    AllPairsError,
    SchemaClashError,
    integrate,
    join_on_condition,
    join_on_inequality,
    join_on_keys,
    union,
)
from blockpipe.operators.discover import value_patterns, value_variants
from blockpipe.operators.joinkeys import suggest_joins
from blockpipe.operators.profile import (
    dataset_summary,
    preview,
    preview_records,
    schema_profile,
)
from blockpipe.operators.recommend import recommend_cleaning, recommend_transformations
from blockpipe.operators.relevance import mutual_information, select_informative
from blockpipe.operators.sampling import sample_rows
from blockpipe.operators.transform import (
    aggregate,
    construct,
    discretize,
    drop_outliers,
    extract_features,
    feature_scores,
    outlier_bounds,
    parse_time,
    reduce_rows,
    select_features,
    smooth,
    split_column,
    years_between,
)

__all__ = [
    "AllPairsError",
    "SchemaClashError",
    "aggregate",
    "construct",
    "correct_types",
    "dataset_summary",
    "discretize",
    "drop_duplicates",
    "drop_missing",
    "drop_outliers",
    "extract_features",
    "feature_scores",
    "impute",
    "integrate",
    "join_on_condition",
    "join_on_inequality",
    "join_on_keys",
    "map_values",
    "mutual_information",
    "outlier_bounds",
    "parse_time",
    "preview",
    "preview_records",
    "recommend_cleaning",
    "recommend_transformations",
    "reduce_rows",
    "sample_rows",
    "schema_profile",
    "select_features",
    "select_informative",
    "smooth",
    "split_column",
    "standardize_names",
    "standardize_text",
    "standardize_values",
    "standardized_names",
    "suggest_joins",
    "union",
    "value_patterns",
    "value_variants",
    "years_between",
]
