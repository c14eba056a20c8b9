"""Cleaning blocks (C1-C7): missing values, duplicates, types, text, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from blockpipe.functions.columns import in_backticks
from blockpipe.functions import present, quoted, standardize_name, strip_whitespace
from blockpipe.plans.ranking import (
    GATHERED_VALUES,
    group_modes,
    largest_group,
    null_safe_join,
    quantiles,
)
from blockpipe.plans.sizing import broadcast_if_small, broadcast_limit_bytes


def drop_missing(
    df: DataFrame,
    how: str = "any",
    subset: Sequence[str] | None = None,
    thresh: int | None = None,
) -> DataFrame:
    """Drop rows with missing values (null, or NaN in float columns)."""
    if how not in ("any", "all"):
        raise ValueError(f"how must be 'any' or 'all', got {how!r}")
    return df.dropna(how=how, thresh=thresh, subset=[in_backticks(c) for c in subset] if subset else None)


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep_by: str | Sequence[str] | None = None,
    keep: str = "first",
) -> DataFrame:
    """Drop duplicate rows, judged on ``subset`` (default: all columns).

    Without ``keep_by`` any one row of each duplicate group survives
    (``dropDuplicates``). With ``keep_by`` the row with the smallest
    (``keep="first"``) or largest (``keep="last"``) ``keep_by`` values
    survives, ties broken by the remaining columns, so reruns agree. Both are
    one aggregation with map-side combine; a hot key costs one buffer row. Rows with
    text or nested columns are kept by sorting each partition, as such buffers are
    not of fixed width.
    """
    if keep_by is None:
        return df.dropDuplicates(list(subset) if subset else None)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', got {keep!r}")
    order = [keep_by] if isinstance(keep_by, str) else list(keep_by)
    keys = list(subset) if subset else list(df.columns)
    # the group key is not repeated inside the kept row: it is shuffled once
    rest = [c for c in df.columns if c not in order and c not in keys]
    # a missing keep_by value never wins: it ranks after (first) or before (last) any value
    flags = [
        (quoted(c).isNull() if keep == "first" else quoted(c).isNotNull()).alias(f"_bp_flag{i}")
        for i, c in enumerate(order)
    ]
    ranked_cols = []
    for flag, c in zip(flags, order):
        ranked_cols += [flag, quoted(c)]
    ranked = F.struct(*ranked_cols, *[quoted(c) for c in rest])
    pick = F.min(ranked) if keep == "first" else F.max(ranked)
    kept = df.groupBy(*[quoted(k) for k in keys]).agg(pick.alias("_bp_row"))
    return kept.select(
        *[quoted(c) if c in keys else F.col("_bp_row").getField(c).alias(c) for c in df.columns]
    )


IMPUTE_STRATEGIES = ("constant", "mean", "median", "mode")


def impute(
    df: DataFrame,
    cols: Sequence[str] | str,
    strategy: str = "mean",
    by: Sequence[str] | str | None = None,
    value=None,
    approx: bool = False,
    quantile_method: str = "auto",
) -> DataFrame:
    """Fill missing values (null and NaN) of ``cols``.

    ``strategy``: ``constant`` (``value``), ``mean``, ``median`` or ``mode``,
    over the whole column or per group of ``by``. Statistics come from one
    aggregation (global: a scalar subquery, computed once and used as a
    constant; per group: a table with one row per group, materialized and
    measured, then broadcast when small and otherwise sort-merge joined with
    skew splitting). Median is exact unless ``approx=True``:
    ``quantile_method`` as in ``plans.quantiles``; by default the values of big groups
    are narrowed by counting, and what is left is gathered.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    by = [by] if isinstance(by, str) else list(by or [])
    fill = "_bp_fill_"
    while any(c.startswith(fill) for c in df.columns):
        fill = "_" + fill
    if strategy not in IMPUTE_STRATEGIES:
        raise ValueError(f"strategy must be one of {IMPUTE_STRATEGIES}, got {strategy!r}")
    if strategy == "constant":
        if value is None:
            raise ValueError("constant imputation needs a value")
        for c in cols:
            if isinstance(df.schema[c].dataType, IntegralType) and isinstance(value, float) and not value.is_integer():
                raise ValueError(f"{value!r} is no whole number, but column {c!r} holds only such")
        filled = {c: F.coalesce(present(df, c), F.lit(value).cast(df.schema[c].dataType)) for c in cols}
        return df.withColumns(filled)

    if strategy == "median" and not approx and quantile_method == "auto":
        # no group needs narrowing: every column's median from one aggregation
        if largest_group(df, by) <= GATHERED_VALUES:
            quantile_method = "percentile"
    one_pass_median = strategy == "median" and not approx and quantile_method == "percentile"

    def medians(keys):
        exprs = [F.percentile(present(df, c).cast("double"), 0.5).alias(f"{fill}{c}") for c in cols]
        return df.groupBy(*keys).agg(*exprs)

    if not by:
        # a global statistic is one value: a scalar subquery, computed once
        filled = {}
        modes = group_modes(df, cols, [], [f"{fill}{x}" for x in cols]) if strategy == "mode" else None
        for c in cols:
            if strategy == "mean":
                stat = df.select(F.avg(present(df, c))).scalar()
            elif one_pass_median:
                stat = medians([]).select(quoted(f"{fill}{c}")).scalar()
            elif strategy == "median":
                stat = quantiles(df, present(df, c), [0.5], approx=approx, method=quantile_method).scalar()
            else:
                stat = modes.select(quoted(f"{fill}{c}")).scalar().cast(df.schema[c].dataType)
            filled[c] = F.coalesce(present(df, c), stat)
        return df.withColumns(filled)

    if strategy == "mean":
        stats = df.groupBy(*by).agg(*[F.avg(present(df, c)).alias(f"{fill}{c}") for c in cols])
    elif one_pass_median:
        stats = medians(by)
    elif strategy == "median":
        parts = [
            quantiles(df, present(df, c), [0.5], by=by, names=[f"{fill}{c}"], approx=approx,
                      method=quantile_method)
            for c in cols
        ]
        stats = parts[0]
        for p in parts[1:]:
            stats = null_safe_join(stats, p, by, "full")
    else:
        stats = group_modes(df, cols, by, [f"{fill}{c}" for c in cols])

    # one row per group: broadcast when measured small, else a shuffle join
    stats, _ = broadcast_if_small(stats)
    joined = null_safe_join(df, stats, by, "left")
    filled = {}
    for c in cols:
        stat = quoted(f"{fill}{c}")
        if strategy == "mode":
            stat = stat.cast(df.schema[c].dataType)
        filled[c] = F.coalesce(present(df, c), stat)
    return joined.withColumns(filled).select(*[quoted(c) for c in df.columns])


def correct_types(
    df: DataFrame, types: Mapping[str, str | DataType], on_error: str = "null"
) -> DataFrame:
    """Cast columns to the given types; unparsable values become null
    (``on_error="null"``, ``try_cast``) or fail the job (``"fail"``)."""
    if on_error not in ("null", "fail"):
        raise ValueError(f"on_error must be 'null' or 'fail', got {on_error!r}")
    cast = {}
    for c, t in types.items():
        col = quoted(c)
        cast[c] = col.try_cast(t) if on_error == "null" else col.cast(t)
    return df.withColumns(cast)


def standardize_text(
    df: DataFrame,
    cols: Sequence[str] | str,
    case: str | None = "upper",
    strip: bool = True,
    spaces: str = "remove",
) -> DataFrame:
    """Uniform case and spacing. ``spaces``: ``remove`` all inner whitespace,
    ``collapse`` runs to one blank, or ``keep``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if case not in ("upper", "lower", "title", None):
        raise ValueError(f"case must be 'upper', 'lower', 'title' or None, got {case!r}")
    if spaces not in ("remove", "collapse", "keep"):
        raise ValueError(f"spaces must be 'remove', 'collapse' or 'keep', got {spaces!r}")
    out = {}
    for c in cols:
        e = quoted(c)
        if strip:
            e = strip_whitespace(e)
        if spaces == "remove":
            e = F.regexp_replace(e, r"(?U)\s+", "")
        elif spaces == "collapse":
            e = F.regexp_replace(e, r"(?U)\s+", " ")
        if case == "upper":
            e = F.upper(e)
        elif case == "lower":
            e = F.lower(e)
        elif case == "title":
            e = F.initcap(e)
        out[c] = e
    return df.withColumns(out)


def _mapping_rows(mapping: Mapping, text: bool) -> list[tuple]:
    """The entries of a dict; for a text column both sides as text."""
    def as_text(x):
        return x if x is None or isinstance(x, str) else str(x)

    rows: dict = {}
    for k, v in mapping.items():
        k, v = (as_text(k), as_text(v)) if text else (k, v)
        if k in rows and rows[k] != v:
            raise ValueError(f"value {k!r} is mapped to both {rows[k]!r} and {v!r}")
        rows[k] = v
    return [(k, v) for k, v in rows.items() if k is not None and v is not None]


def map_values(
    df: DataFrame,
    col: str,
    mapping: Mapping | DataFrame,
    out: str | None = None,
) -> DataFrame:
    """Replace variants by one form; unmapped values stay as they are.

    ``mapping`` is a dict or a DataFrame ``(from, to)``; either is a table of the
    column's type, left-joined on the value, whatever its size (broadcast if
    it is small). A null ``from`` matches nothing and a null ``to`` changes
    nothing. A value with two different targets is an error: at once in a dict, when
    the result is computed for a DataFrame.
    """
    out = out or col
    kind = df.schema[col].dataType
    if isinstance(mapping, Mapping):
        rows = _mapping_rows(mapping, isinstance(kind, StringType))
        ddl = StructType([StructField("_bp_from", kind), StructField("_bp_to", kind)])
        table = df.sparkSession.createDataFrame(rows, ddl)
        if sum(64 + 4 * len(str(x)) for pair in rows for x in pair) <= broadcast_limit_bytes(df):
            table = F.broadcast(table)  # its rows are here, so their size is known
    else:
        a, b = mapping.columns[:2]
        pairs = mapping.select(quoted(a).cast(kind).alias("_bp_from"), quoted(b).cast(kind).alias("_bp_to"))
        clash = F.raise_error(F.concat(F.lit("a value is mapped to several targets: "), F.col("_bp_from").cast("string")))
        one = F.when(F.min("_bp_to") != F.max("_bp_to"), clash.cast(kind)).otherwise(F.min("_bp_to"))
        table = pairs.where("_bp_from is not null").groupBy("_bp_from").agg(one.alias("_bp_to"))
    joined = df.join(table, quoted(col) == F.col("_bp_from"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_bp_to"), quoted(col))).drop("_bp_from", "_bp_to")


def standardized_names(names: Sequence[str]) -> list[str]:
    """Apply the name rule to a list of names; two names that collide fail."""
    out = [n.strip().lower().replace(" ", "_") for n in names]
    seen: dict[str, str] = {}
    for orig, new in zip(names, out):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {orig!r} both standardize to {new!r}")
        seen[new] = orig
    return out


def standardize_names(df: DataFrame) -> DataFrame:
    """Rename every column by the name rule (trim, lower, blank to ``_``)."""
    return df.toDF(*standardized_names(df.columns))


def standardize_values(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Apply the name rule to the values of text columns."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.withColumns({c: standardize_name(c) for c in cols})


__all__ = [
    "drop_missing",
    "drop_duplicates",
    "impute",
    "correct_types",
    "standardize_text",
    "map_values",
    "standardize_names",
    "standardized_names",
    "standardize_values",
]
