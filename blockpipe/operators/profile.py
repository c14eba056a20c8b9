"""Preview and column profile (B1-B4).

Only ``n`` preview rows and one row of per-column flags are ever small enough
to reach the driver; everything here returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DayTimeIntervalType,
    DoubleType,
    FloatType,
    MapType,
    StructType,
    YearMonthIntervalType,
)

from blockpipe.functions import as_column, is_missing, quoted

# Fixed value: preview rows per block by default.
DEFAULT_PREVIEW_ROWS = 10

PROFILE_COLUMNS = ("column_name", "data_type", "has_nulls")


def preview(df: DataFrame, n: int = DEFAULT_PREVIEW_ROWS, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` a top-k (``TakeOrderedAndProject``)."""
    if order_by:
        df = df.orderBy(*[as_column(c) for c in order_by])
    return df.limit(n)


def _has_fraction(kind: DataType) -> bool:
    """Whether a type is, or holds somewhere, floats or doubles (map keys aside)."""
    if isinstance(kind, ArrayType):
        return _has_fraction(kind.elementType)
    if isinstance(kind, MapType):
        return _has_fraction(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_fraction(f.dataType) for f in kind.fields)
    return isinstance(kind, (DoubleType, FloatType))


def _without_nan(c: Column, kind: DataType) -> Column:
    """``c`` with every NaN in it null."""
    if not _has_fraction(kind):
        return c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: _without_nan(x, kind.valueType))
    if isinstance(kind, StructType):
        fields = [_without_nan(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return F.when(~F.isnan(c), c)


def _json_ready(df: DataFrame) -> list[Column]:
    """Columns as preview records show them: NaN as null, intervals as
    seconds, everything else unchanged."""
    out = []
    for field in df.schema.fields:
        c = quoted(field.name)
        if _has_fraction(field.dataType):
            c = _without_nan(c, field.dataType)
        elif isinstance(field.dataType, DayTimeIntervalType):
            q = "`" + field.name.replace("`", "``") + "`"
            c = (
                F.expr(f"extract(DAY FROM {q})") * 86400
                + F.expr(f"extract(HOUR FROM {q})") * 3600
                + F.expr(f"extract(MINUTE FROM {q})") * 60
                + F.expr(f"extract(SECOND FROM {q})")
            ).cast("double")
        elif isinstance(field.dataType, YearMonthIntervalType):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return out


def preview_records(
    dfs: Mapping[str, DataFrame] | DataFrame,
    n: int = DEFAULT_PREVIEW_ROWS,
    order_by: Sequence[str] | Mapping[str, Sequence[str]] | None = None,
    as_array: bool = False,
) -> DataFrame:
    """``(dataset, record)``: preview rows as JSON objects, ISO timestamps at
    millisecond precision, nulls kept as ``null``. ``order_by`` is one
    ordering for all datasets or ``{dataset: ordering}``; without one, which
    rows come first is up to the scan. ``as_array=True`` gives one row per
    dataset, ``(dataset, records)``, holding the ``n`` rows as one JSON array
    in preview order (at most ``n`` rows are gathered per dataset)."""
    if isinstance(dfs, DataFrame):
        dfs = {"result": dfs}
    opts = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "dateFormat": "yyyy-MM-dd'T'00:00:00.000",
    }
    parts = []
    for name, df in dfs.items():
        order = order_by.get(name) if isinstance(order_by, Mapping) else order_by
        head = preview(df, n, order)
        rec = F.to_json(F.struct(*_json_ready(head)), opts)
        rows = head.select(F.lit(name).alias("dataset"), rec.alias("record"))
        if as_array:
            # number the (at most n) rows in preview order, then join them in that order
            numbered = head.select(F.struct(*_json_ready(head)).alias("_bp_r")).withColumn(
                "_bp_i", F.monotonically_increasing_id()
            )
            ordered = F.sort_array(F.collect_list(F.struct("_bp_i", "_bp_r")))
            rows = numbered.agg(
                F.lit(name).alias("dataset"),
                F.to_json(F.transform(ordered, lambda e: e["_bp_r"]), opts).alias("records"),
            )
        parts.append(rows)
    return reduce(DataFrame.unionAll, parts)


def schema_profile(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """``(column_name, data_type, has_nulls)`` in column order.

    One aggregation over the whole frame computes every flag (partial
    aggregation per task, one tiny final merge). ``sample_rows`` limits the
    check to the first rows (a quick look at a sample).
    """
    src = df.limit(sample_rows) if sample_rows is not None else df
    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame([], _profile_schema())
    flags = src.agg(
        *[F.bool_or(is_missing(df, f.name)).alias(f"_bp_{i}") for i, f in enumerate(fields)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.coalesce(F.col(f"_bp_{i}"), F.lit(False)).alias("has_nulls"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return flags.select(F.inline(rows))


def _profile_schema() -> StructType:
    return StructType.fromDDL("column_name string, data_type string, has_nulls boolean")


def dataset_summary(dfs: Mapping[str, DataFrame], sample_rows: int | None = None) -> DataFrame:
    """Profile of every dataset of a block, with a leading ``dataset`` column."""
    parts = [
        schema_profile(df, sample_rows).select(F.lit(name).alias("dataset"), "*")
        for name, df in dfs.items()
    ]
    return reduce(DataFrame.unionAll, parts)
