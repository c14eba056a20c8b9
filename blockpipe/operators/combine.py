"""Blocks over several datasets (E1-E4): merge records, joins, unions."""

from __future__ import annotations

import contextlib
import io
import math
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, StringType

from blockpipe.functions import as_column, quoted
from blockpipe.functions.columns import in_backticks
from blockpipe.plans.sizing import broadcast_if_small, measured
from blockpipe.session import shuffle_partitions

JOIN_KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


class SchemaClashError(ValueError):
    """A column shared by several inputs has different types."""


def integrate(
    dfs: Sequence[DataFrame] | Mapping[str, DataFrame],
    key: Sequence[str] | str,
    precedence: Sequence[str] | None = None,
    on_duplicate: str = "error",
) -> DataFrame:
    """Merge the records of several tables into one row per key.

    For every column, the value comes from the first table in precedence
    order (list order, or ``precedence`` names for a dict) whose record has one
    that is not null. It is planned as one union and one aggregation: a single
    shuffle for any number of tables, map-side combine, and one buffer per table,
    so a hot key costs one buffer row per task. A record with a null in its key
    matches no other and stays as it is.

    Keys must be unique within a table: by default a repeated one makes the job that
    computes the result fail (found in the same aggregation). With
    ``on_duplicate="merge"`` a table's smallest record for the key (compared column by
    column) stands for it, always as a whole.

    A shared column must have one type everywhere (``SchemaClashError``); ``merge``
    can't order records with map or variant columns (``ValueError``).
    """
    if on_duplicate not in ("merge", "error"):
        raise ValueError(f"on_duplicate must be 'merge' or 'error', got {on_duplicate!r}")
    keys = [key] if isinstance(key, str) else list(key)
    if isinstance(dfs, Mapping):
        names = list(precedence) if precedence else list(dfs)
        frames = [dfs[n] for n in names]
    else:
        frames = list(dfs)
        names = [str(i) for i in range(len(frames))]
    kinds: dict[str, DataType] = {}
    for name, df in zip(names, frames):
        for f in df.schema.fields:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise SchemaClashError(
                    f"column {f.name!r} is {f.dataType.simpleString()} in dataset {name!r}, "
                    f"elsewhere {kinds[f.name].simpleString()}"
                )
            if on_duplicate == "merge" and re.search("map<|variant", f.dataType.simpleString()):
                raise ValueError(f"records with column {f.name!r} can't be ordered; remove it or repeated keys")
    values = [c for c in kinds if c not in keys]
    key_cols = [quoted(k) for k in keys]
    no_null = F.lit(True)
    for k in key_cols:
        no_null = no_null & k.isNotNull()

    def record(df: DataFrame) -> Column:
        own = [quoted(c).alias(f"v{i}") for i, c in enumerate(values) if c in df.columns]
        return F.struct(*own) if own else F.struct(F.lit(0).alias("none"))

    records = [record(df) for df in frames]
    types = [df.select(r).schema[0].dataType for df, r in zip(frames, records)]
    tagged = [
        df.where(no_null).select(
            *key_cols,
            *[
                (records[i] if i == j else F.lit(None).cast(types[i])).alias(f"_bp_r{i}")
                for i in range(len(frames))
            ],
        )
        for j, df in enumerate(frames)
    ]
    stacked = reduce(DataFrame.unionAll, tagged)
    aggs = []
    for i, name in enumerate(names):
        row = F.col(f"_bp_r{i}")
        if on_duplicate == "merge":
            pick = F.min(row)
        else:
            clash = F.raise_error(F.lit(f"dataset {name!r} has a repeated value of {keys}"))
            pick = F.when(F.count(row) > 1, clash).otherwise(F.any_value(row, True))
        aggs.append(pick.alias(f"_bp_r{i}"))
    merged = stacked.groupBy(*key_cols).agg(*aggs)
    out = [
        F.coalesce(*[F.col(f"_bp_r{i}").getField(f"v{j}") for i, df in enumerate(frames) if c in df.columns]).alias(c)
        for j, c in enumerate(values)
    ]
    whole = merged.select(*key_cols, *out)
    for df in frames:
        alone = [quoted(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in [*keys, *values]]
        if any(df.schema[k].nullable for k in keys):
            whole = whole.unionAll(df.where(~no_null).select(*alone))
    return whole


def join_on_keys(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    split_full: bool = False,
) -> DataFrame:
    """Join on common key columns. Adaptive execution picks broadcast (by the
    measured size of a side) or sort-merge, and splits skewed partitions of
    the preserved side of inner, left and right joins.

    It cannot split a full outer join. ``split_full=True`` plans one as a
    left join plus the right rows whose key is absent on the left (an anti
    join against the left's distinct keys, which map-side combine shrinks),
    so a hot key is split in both parts; it costs a second read of both sides.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"how must be one of {JOIN_KINDS}, got {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    if how == "full" and split_full:
        matched = left.join(right, on=keys, how="left")
        right_only = right.join(left.select(*keys).distinct(), on=keys, how="left_anti")
        # by position, as columns besides the keys may share a name: keys, left's, right's
        nulls = [F.lit(None).cast(f.dataType) for f in left.schema.fields if f.name not in keys]
        own = [quoted(c) for c in right.columns if c not in keys]
        return matched.unionAll(right_only.select(*[quoted(k) for k in keys], *nulls, *own))
    return left.join(right, on=keys, how=how)


# Rows of either side that meet in one tile of a hot bucket, if no larger tiles are needed
# to keep to about TILES of them (or two for each shuffle partition) in all; no tile is larger
# than LARGEST_TILE for that.
TILE_ROWS = 20_000
TILES = 512
LARGEST_TILE = 1 << 20


class AllPairsError(ValueError):
    """A join would compare every left row with every right row."""


def _compares_all_pairs(joined: DataFrame) -> bool:
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        joined.explain("simple")
    return re.search("NestedLoopJoin|CartesianProduct", plan.getvalue()) is not None


def join_on_condition(
    left: DataFrame,
    right: DataFrame,
    cond: str | Column,
    how: str = "inner",
    band: tuple[str | Column, str | Column, float, float] | None = None,
    all_pairs: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Join on any condition (theta join).

    A condition with an equality between the sides is an equi-join. One without is a
    nested loop over all pairs, which must be asked for with ``all_pairs=True``
    (else ``AllPairsError``), or a band join.

    ``band=(l, r, lo, hi)`` states that ``cond`` implies ``l + lo <= r <= l + hi``.
    Then both sides get buckets of width ``hi - lo``: the left row the bucket of
    ``l``, and the right row is copied to the buckets of all left values that can
    match it and one more on either side, which takes up any rounding of the
    bucket arithmetic. The join is an equi-join on the bucket with ``cond`` as
    residual filter. Each left row meets each right row at most once, so outer,
    semi and anti joins stay exact. Right and full joins are the inner or left join
    and the right rows that match nothing, found by the same band the other way.
    Whole numbers and decimals are bucketed in decimal arithmetic.

    Many equal values share a bucket however narrow the band is. So the buckets' rows
    are counted first, and a bucket whose pairs exceed ``tile_rows`` squared is cut into
    tiles of about ``tile_rows`` rows of each side: a left row goes to one row of
    tiles, a right row to one column, and each pair meets in one tile. Where that makes
    more than about ``TILES`` tiles, which would copy each row the more often the more
    rows there are, all tiles are larger instead: p pairs in t tiles take n + m + 2 sqrt(p t)
    copies of n and m rows, so what is shuffled grows as the rows do. The rows of
    such buckets are written once with their tiles' numbers, so a lost executor can't
    change them. Counting runs when the join is called.

    A semi or anti join on one inequality needs no pairs: ``join_on_inequality``.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"how must be one of {JOIN_KINDS}, got {how!r}")
    cond_col = F.expr(cond) if isinstance(cond, str) else cond
    if band is None:
        joined = left.join(right, on=cond_col, how=how)
        if not all_pairs and _compares_all_pairs(joined):
            raise AllPairsError("the condition has no equality: give a band, or all_pairs=True for small inputs")
        return joined
    l_col, r_col, lo, hi = band
    if hi <= lo:
        raise ValueError("band must have hi > lo")
    if how in ("right", "full"):
        matched = join_on_condition(left, right, cond, "inner" if how == "right" else "left", band, tile_rows=tile_rows)
        alone = join_on_condition(right, left, cond, "left_anti", (r_col, l_col, -hi, -lo), tile_rows=tile_rows)
        nulls = [F.lit(None).cast(f.dataType) for f in left.schema.fields]
        return matched.unionAll(alone.select(*nulls, *[alone[c] for c in alone.columns]))
    lv, rv, lo, hi = _band_values(left, right, as_column(l_col), as_column(r_col), lo, hi)
    width = hi - lo
    lb = left.withColumn("_bp_bl", _bucket(lv / width))
    rb = right.withColumn("_bp_br", F.explode(_buckets((rv - hi) / width, (rv - lo) / width)))
    same = F.col("_bp_bl") == F.col("_bp_br")
    hot = _hot_buckets(lb, rb, tile_rows)
    if hot.isEmpty():
        return lb.join(rb, on=same & cond_col, how=how).drop("_bp_bl", "_bp_br")
    hot, _ = broadcast_if_small(hot)
    cold_l = lb.join(hot, F.col("_bp_bl") == F.col("_bp_b"), "left_anti")
    cold_r = rb.join(hot, F.col("_bp_br") == F.col("_bp_b"), "left_anti")
    cold = cold_l.join(cold_r, on=same & cond_col, how=how).drop("_bp_bl", "_bp_br")
    return cold.unionAll(_tiled(lb, rb, hot, cond_col, how))


def _hot_buckets(lb: DataFrame, rb: DataFrame, tile_rows: int) -> DataFrame:
    """Buckets with too many pairs for one task, and the tiles of each side: at most a
    row for every ``tile_rows`` squared pairs. All tiles are squares of one size."""
    lefts = lb.groupBy(F.col("_bp_bl").alias("_bp_b")).agg(F.count(F.lit(1)).alias("_bp_n"))
    rights = rb.groupBy(F.col("_bp_br").alias("_bp_b")).agg(F.count(F.lit(1)).alias("_bp_m"))
    pairs = F.col("_bp_n").cast("double") * F.col("_bp_m")
    hot, _, _ = measured(lefts.join(rights, "_bp_b").where(pairs > float(tile_rows) ** 2))
    tiles = max(TILES, 2 * shuffle_partitions(hot.sparkSession))
    edge = math.sqrt((hot.agg(F.sum(pairs)).first()[0] or 0) / tiles)
    edge = max(tile_rows, min(edge, LARGEST_TILE))
    cuts = [F.ceil(F.col(c) / edge).alias(out) for c, out in (("_bp_n", "_bp_tl"), ("_bp_m", "_bp_tr"))]
    return hot.select("_bp_b", *cuts)


def _tiled(lb: DataFrame, rb: DataFrame, hot: DataFrame, cond: Column, how: str) -> DataFrame:
    """The join of the left rows in hot buckets: inner, left, semi or anti."""

    def numbered(side: DataFrame, bucket: str, tiles: str, own: str) -> DataFrame:
        rows = side.join(hot, F.col(bucket) == F.col("_bp_b")).withColumn(f"{own}_id", F.monotonically_increasing_id())
        return rows.withColumn(own, F.pmod(F.xxhash64(f"{own}_id"), F.col(tiles))).drop("_bp_b").checkpoint(eager=True)

    def copied(side: DataFrame, tiles: str, other: str) -> DataFrame:
        return side.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(tiles) - 1)))

    lefts = numbered(lb, "_bp_bl", "_bp_tl", "_bp_l")
    rights = numbered(rb, "_bp_br", "_bp_tr", "_bp_r")
    extra = ["_bp_bl", "_bp_br", "_bp_tl", "_bp_tr", "_bp_l", "_bp_r", "_bp_l_id", "_bp_r_id", "_bp_l2", "_bp_r2"]
    many_l, many_r = copied(lefts, "_bp_tr", "_bp_r2"), copied(rights, "_bp_tl", "_bp_l2").drop("_bp_tl", "_bp_tr")
    same = [F.col(a) == F.col(b) for a, b in (("_bp_bl", "_bp_br"), ("_bp_l", "_bp_l2"), ("_bp_r2", "_bp_r"))]
    on = reduce(Column.__and__, same) & cond
    if how == "inner":
        return many_l.join(many_r, on, "inner").drop(*extra)
    # a left row is in several tiles: it has a partner if it has one in any of them
    matched = many_l.join(many_r, on, "left_semi").select(F.col("_bp_l_id").alias("_bp_found")).distinct()
    kind = "left_semi" if how == "left_semi" else "left_anti"
    picked = lefts.join(matched, F.col("_bp_l_id") == F.col("_bp_found"), kind).drop(*extra)
    if how != "left":
        return picked
    nulls = [F.lit(None).cast(f.dataType) for f in rb.schema.fields if f.name != "_bp_br"]
    return many_l.join(many_r, on, "inner").drop(*extra).unionAll(picked.select("*", *nulls))


_COMPARED = {
    "<": (F.max, Column.__lt__),
    "<=": (F.max, Column.__le__),
    ">": (F.min, Column.__gt__),
    ">=": (F.min, Column.__ge__),
}


def join_on_inequality(
    left: DataFrame,
    right: DataFrame,
    inequality: tuple[str | Column, str, str | Column],
    on: Sequence[str] | str = (),
    how: str = "left_semi",
) -> DataFrame:
    """Left rows for which some right row (``left_anti``: none) has the same ``on`` and a
    value that stands in the inequality ``(left value, "<", "<=", ">" or ">=", right value)``.

    Some value is larger if the largest is: the right side is reduced to its
    largest (smallest) value for each key, with map-side combine, so nothing meets in
    pairs. Without ``on`` that is one number in a filter; else one row a key, broadcast
    if measured small, and otherwise joined with the left side's hot keys split.
    Nulls stand in no inequality and null keys match nothing, as in SQL's ``exists``;
    NaN is above all numbers. Text is compared with text only (``TypeError``), as its
    order is not that of the numbers written in it.
    """
    l_val, sign, r_val = inequality
    if sign not in _COMPARED:
        raise ValueError(f"the inequality must be one of {tuple(_COMPARED)}, got {sign!r}")
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"how must be 'left_semi' or 'left_anti', got {how!r}")
    extreme, compared = _COMPARED[sign]
    l_val, r_val = as_column(l_val), as_column(r_val)
    text = [isinstance(df.select(c).schema[0].dataType, StringType) for df, c in ((left, l_val), (right, r_val))]
    if text[0] != text[1]:
        raise TypeError("text can't be compared with values of another type: cast one side")
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        holds = F.coalesce(compared(l_val, right.select(extreme(r_val)).scalar()), F.lit(False))
        return left.where(holds if how == "left_semi" else ~holds)
    best = right.groupBy(*[quoted(k).alias(f"_bp_k{i}") for i, k in enumerate(keys)]).agg(extreme(r_val).alias("_bp_x"))
    best, _ = broadcast_if_small(best)
    same = [left[in_backticks(k)] == F.col(f"_bp_k{i}") for i, k in enumerate(keys)]
    return left.join(best, reduce(Column.__and__, same) & compared(l_val, F.col("_bp_x")), how)


# Buckets beyond these numbers, where doubles have no more places behind the point,
# are one bucket at either end; NaN, larger than all numbers, is in the upper one.
_MOST_BUCKET, _END_BUCKET = 1 << 52, 1 << 60


def _bucket(ratio: Column) -> Column:
    size = ratio.cast("double")
    inner = F.when(F.abs(size) < _MOST_BUCKET, F.floor(ratio).cast("bigint"))
    return F.when(F.isnan(size) | (size >= _MOST_BUCKET), _END_BUCKET).when(size <= -_MOST_BUCKET, -_END_BUCKET).otherwise(inner)


def _buckets(first: Column, last: Column) -> Column:
    """All buckets from one before ``first`` to one after ``last``; null for null."""
    lo, hi = first.cast("double"), last.cast("double")
    within = ~F.isnan(lo) & ~F.isnan(hi) & (lo < _MOST_BUCKET) & (hi > -_MOST_BUCKET)
    start = F.when(lo <= -_MOST_BUCKET, -_MOST_BUCKET).otherwise(F.floor(F.when(within, first)).cast("bigint") - 1)
    stop = F.when(hi >= _MOST_BUCKET, _MOST_BUCKET).otherwise(F.floor(F.when(within, last)).cast("bigint") + 1)
    none = F.array().cast("array<bigint>")
    inner = F.when(within, F.sequence(F.when(within, start), F.when(within, stop))).otherwise(none)
    above = F.when(F.isnan(hi) | (hi >= _MOST_BUCKET - 4), F.array(F.lit(_END_BUCKET))).otherwise(none)
    below = F.when(lo <= -_MOST_BUCKET + 4, F.array(F.lit(-_END_BUCKET))).otherwise(none)
    return F.when(first.isNotNull() & last.isNotNull(), F.concat(below, inner, above))


def _band_values(left, right, l_col, r_col, lo, hi):
    """The band's values and bounds in decimals if both sides are exact, else doubles."""
    kinds = [df.select(c).schema[0].dataType for df, c in ((left, l_col), (right, r_col))]
    if all(isinstance(k, (IntegralType, DecimalType)) for k in kinds):
        as_type, lo, hi = "decimal(28,8)", Decimal(str(lo)), Decimal(str(hi))
        return l_col.cast(as_type), r_col.cast(as_type), F.lit(lo).cast("decimal(20,8)"), F.lit(hi).cast("decimal(20,8)")
    return l_col.cast("double"), r_col.cast("double"), F.lit(float(lo)), F.lit(float(hi))


def union(dfs: Sequence[DataFrame] | Mapping[str, DataFrame], distinct: bool = False) -> DataFrame:
    """Stack datasets with the same columns (by name) and types.

    A differing schema is an error here, before any job runs; plain
    ``unionByName`` would accept text against numbers and fail mid-job.
    """
    frames = list(dfs.values()) if isinstance(dfs, Mapping) else list(dfs)
    if not frames:
        raise ValueError("union needs at least one dataset")
    want = {f.name: f.dataType for f in frames[0].schema.fields}
    for i, df in enumerate(frames[1:], start=1):
        got = {f.name: f.dataType for f in df.schema.fields}
        if got != want:
            raise ValueError(
                f"dataset {i} schema {sorted((k, v.simpleString()) for k, v in got.items())} "
                f"differs from {sorted((k, v.simpleString()) for k, v in want.items())}"
            )
    out = reduce(DataFrame.unionByName, frames)
    return out.distinct() if distinct else out
