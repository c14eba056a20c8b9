"""Rule-based suggestions for the next cleaning or transformation block (B5, B6).

The suggestions come from counters over the whole data, one aggregation per
dataset (plus one for duplicate rows), never from a sample. Each suggestion
names a dataset, a column, the block to use, a reason, and how many rows it
touches. At most ``limit`` suggestions (5 by default) are kept.

The candidate table holds at most a few rows per column of the inputs, so the
final ranking runs on a schema-sized table, not on the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    MapType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from blockpipe.functions.columns import TEXT_TIME_OPTS
from blockpipe.functions import is_missing, quoted

DEFAULT_LIMIT = 5

RESULT_DDL = (
    "rank int, dataset string, column_name string, technique string, reason string, affected_rows bigint"
)

# The suggestion texts. ``{c}``, ``{d}``, ``{e}`` are column and
# dataset names, ``{n}`` a count.
CLEANING_REASONS = {
    "impute": "Column `{c}` has {n} missing values; fill them (mean, median, mode or a constant) or drop those rows.",
    "standardize_text": "Column `{c}` has {n} values with leading or trailing whitespace; trim them and use one case.",
    "correct_types": "Column `{c}` is text but all {n} values are numbers; cast it to a numeric type.",
    "drop_duplicates": "Dataset `{d}` has {n} duplicate rows; drop them.",
}
TRANSFORMATION_REASONS = {
    "split_column": "Column `{c}` has {n} space-separated parts in every value; split it into {n} columns.",
    "construct": "Column `{c}` is a point in time; derive year, month, day or weekday columns from it.",
    "discretize": "Column `{c}` is continuous; group its values into intervals.",
    "join_on_keys": "Datasets `{d}` and `{e}` share the column(s) `{c}`; join them on it.",
    "union": "Datasets `{d}` and `{e}` have the same columns and types; stack them with a union.",
}
TRANSFORMATION_PRIORITY = ("split_column", "construct", "discretize", "join_on_keys", "union")


def _text(template: str, **parts: str | Column) -> Column:
    """Fill a reason template with literals or columns, as one string expression."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        pieces.append(F.lit(head))
        v = parts[key]
        pieces.append(v.cast("string") if isinstance(v, Column) else F.lit(v))
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _candidate(priority, dataset, column, technique, reason, affected, keep) -> Column:
    return F.struct(
        F.lit(priority).alias("priority"),
        F.lit(dataset).alias("dataset"),
        F.lit(column).cast("string").alias("column_name"),
        F.lit(technique).alias("technique"),
        reason.alias("reason"),
        affected.cast("bigint").alias("affected_rows"),
        keep.alias("keep"),
    )


def _rank(candidates: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    # a schema-sized table: one window without partitions is fine here
    w = Window.orderBy(*order)
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit).select(
        "rank", "dataset", "column_name", "technique", "reason", "affected_rows"
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_DDL)


# Types whose values Spark hashes whole; text only in the default collation.
_HASHED_TYPES = (NumericType, BinaryType, BooleanType, DateType, TimestampType, TimestampNTZType)


def _row_digest(df: DataFrame) -> Column:
    """16 bytes that stand for a whole row: two chains of hashes over its typed columns,
    each with whether it is null (hashes pass over nulls). Nested and other types are hashed
    as JSON, with nulls inside and map entries in key order; minus zero is zero."""
    parts = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = c + F.lit(0.0)
        elif not (isinstance(f.dataType, _HASHED_TYPES) or f.dataType == StringType()):
            held = F.array_sort(F.map_entries(c)) if isinstance(f.dataType, MapType) else c
            exact = {"ignoreNullFields": "false", **TEXT_TIME_OPTS}  # to the microsecond
            c = F.to_json(F.struct(held.alias("v")), exact)
        parts += [quoted(f.name).isNull(), c]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def recommend_cleaning(dfs: Mapping[str, DataFrame], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Up to ``limit`` cleaning suggestions, most affected rows first.

    Rules: missing values (null, NaN) -> ``impute``; text with leading or
    trailing whitespace -> ``standardize_text``; text whose values all parse
    as numbers -> ``correct_types``; repeated rows -> ``drop_duplicates``.

    Two scans per dataset: one aggregation for all counters, which shuffles one row
    per task, and one that counts repeated rows by a 16-byte digest of the row, so
    long texts are never shuffled. Columns of any type are allowed.
    """
    parts = []
    spark = None
    for name, df in dfs.items():
        spark = df.sparkSession
        if not df.columns:
            continue

        def tally(cond: Column) -> Column:
            return F.count_if(cond)

        aggs, cands = [], []
        for i, f in enumerate(df.schema.fields):
            c = quoted(f.name)
            miss = F.col(f"_bp_miss{i}")
            aggs.append(tally(is_missing(df, f.name)).alias(f"_bp_miss{i}"))
            cands.append(_candidate(0, name, f.name, "impute",
                                    _text(CLEANING_REASONS["impute"], c=f.name, n=miss), miss, miss > 0))
            if isinstance(f.dataType, StringType):
                pad, cnt, num = (F.col(f"_bp_{k}{i}") for k in ("pad", "cnt", "num"))
                # same as c != strip(c), but looks at two characters only
                padded = F.left(c, F.lit(1)).rlike(r"(?U)^\s$") | F.right(c, F.lit(1)).rlike(r"(?U)^\s$")
                aggs += [
                    tally(padded).alias(f"_bp_pad{i}"),
                    tally(c.isNotNull()).alias(f"_bp_cnt{i}"),
                    tally(c.try_cast("double").isNotNull()).alias(f"_bp_num{i}"),
                ]
                cands.append(_candidate(0, name, f.name, "standardize_text",
                                        _text(CLEANING_REASONS["standardize_text"], c=f.name, n=pad), pad, pad > 0))
                cands.append(_candidate(0, name, f.name, "correct_types",
                                        _text(CLEANING_REASONS["correct_types"], c=f.name, n=cnt), cnt,
                                        (cnt > 0) & (num == cnt)))
        copies = df.groupBy(_row_digest(df).alias("_bp_d")).agg((F.count(F.lit(1)) - 1).alias("_bp_n"))
        extra = copies.agg(F.coalesce(F.sum("_bp_n"), F.lit(0)).cast("bigint").alias("_bp_dup"))
        n = F.col("_bp_dup")
        repeated = _candidate(0, name, "*", "drop_duplicates",
                              _text(CLEANING_REASONS["drop_duplicates"], d=name, n=n), n, n > 0)
        parts += [df.agg(*aggs).select(F.inline(F.array(*cands))), extra.select(F.inline(F.array(repeated)))]
    if not parts:
        return _empty(spark) if spark else None
    cands = reduce(DataFrame.unionAll, parts).where("keep")
    order = [F.col("affected_rows").desc(), "dataset", "column_name", "technique"]
    return _rank(cands, [F.col(o) if isinstance(o, str) else o for o in order], limit)


_TIME_TYPES = (TimestampType, TimestampNTZType, DateType)
_CONTINUOUS_TYPES = (DoubleType, FloatType, DecimalType)


def recommend_transformations(dfs: Mapping[str, DataFrame], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Up to ``limit`` transformation suggestions, by rule priority
    (split, construct, discretize, join, union), then dataset and column.

    Rules: text whose values all have the same number k >= 2 of
    blank-separated parts -> ``split_column``; timestamps and dates ->
    ``construct`` (date parts); floating-point columns -> ``discretize``; two
    datasets with columns of the same name and type -> ``join_on_keys``; two
    datasets with equal schemas -> ``union``. The last two compare schemas
    on the driver; their ``affected_rows`` are the rows of the first dataset
    (join) or of both (union), counted in the same per-dataset aggregation: every
    dataset is scanned once, however many pairs there are.
    """
    prio = {t: i for i, t in enumerate(TRANSFORMATION_PRIORITY)}
    parts = []
    spark = None
    names = list(dfs)
    for name, df in dfs.items():
        spark = df.sparkSession
        aggs, cands = [], []
        for i, f in enumerate(df.schema.fields):
            c = quoted(f.name)
            cnt = F.col(f"_bp_cnt{i}")
            if isinstance(f.dataType, StringType):
                # parts of split(c, " "): blanks + 1, without building the array
                words = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
                aggs += [F.count(c).alias(f"_bp_cnt{i}"),
                         F.min(words).alias(f"_bp_lo{i}"), F.max(words).alias(f"_bp_hi{i}")]
                lo, hi = F.col(f"_bp_lo{i}"), F.col(f"_bp_hi{i}")
                cands.append(_candidate(prio["split_column"], name, f.name, "split_column",
                                        _text(TRANSFORMATION_REASONS["split_column"], c=f.name, n=lo), cnt,
                                        (cnt > 0) & (lo == hi) & (lo >= 2)))
            elif isinstance(f.dataType, _TIME_TYPES):
                aggs.append(F.count(c).alias(f"_bp_cnt{i}"))
                cands.append(_candidate(prio["construct"], name, f.name, "construct",
                                        _text(TRANSFORMATION_REASONS["construct"], c=f.name), cnt, cnt > 0))
            elif isinstance(f.dataType, _CONTINUOUS_TYPES):
                aggs.append(F.count(c).alias(f"_bp_cnt{i}"))
                cands.append(_candidate(prio["discretize"], name, f.name, "discretize",
                                        _text(TRANSFORMATION_REASONS["discretize"], c=f.name), cnt, cnt > 0))
        aggs.append(F.count(F.lit(1)).alias("_bp_rows"))
        cands.append(_candidate(-1, name, None, "rows", F.lit(""), F.col("_bp_rows"), F.lit(True)))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*cands))))
    if not parts:
        return _empty(spark) if spark else None
    # all single-dataset candidates and row counts in one row (its size is the schemas')
    one = reduce(DataFrame.unionAll, parts).agg(F.collect_list(F.struct("*")).alias("all"))
    counts = F.map_from_entries(
        F.transform(
            F.filter("all", lambda x: x["technique"] == "rows"), lambda x: F.struct(x["dataset"], x["affected_rows"])
        )
    )
    one = one.withColumn("counts", counts)
    found = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sa = {f.name: f.dataType for f in dfs[a].schema.fields}
            sb = {f.name: f.dataType for f in dfs[b].schema.fields}
            shared = [c for c in sa if c in sb and sa[c] == sb[c]]
            pair, rows_a, rows_b = f"{a}, {b}", F.col("counts")[a], F.col("counts")[b]
            if shared:
                cols = ", ".join(shared)
                reason = TRANSFORMATION_REASONS["join_on_keys"].format(d=a, e=b, c=cols)
                found.append(_candidate(prio["join_on_keys"], pair, cols, "join_on_keys", F.lit(reason),
                                        rows_a, F.lit(True)))
            if sa == sb:
                reason = TRANSFORMATION_REASONS["union"].format(d=a, e=b)
                found.append(_candidate(prio["union"], pair, "*", "union", F.lit(reason),
                                        rows_a + rows_b, F.lit(True)))
    every = F.concat(F.col("all"), F.array(*found)) if found else F.col("all")
    cands = one.select(F.inline(every)).where("keep and technique <> 'rows'")
    return _rank(cands, [F.col("priority"), F.col("dataset"), F.col("column_name")], limit)
