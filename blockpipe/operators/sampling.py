"""Samples of an exact size, uniform or weighted, for each stratum (D9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockpipe.functions import quoted
from blockpipe.plans.ranking import null_safe_join, row_hash
from blockpipe.plans.sizing import broadcast_if_small, measured

# Bins for each doubling of a row's priority, and the number of the outermost bins.
_BINS_A_DOUBLING, _END_BIN = 1024, 2_000_000


def sample_rows(
    df: DataFrame,
    n: int | Mapping,
    key: Sequence[str] | str,
    strata: Sequence[str] | str = (),
    weight: str | None = None,
    seed: int = 0,
    out: str = "inclusion_weight",
) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all rows of one with fewer), repeatable, with
    the number of rows that each stands for in the column ``out``.

    A row's priority is a number in (0, 1) from the MD5 of ``seed`` and ``key`` (as text
    with ``|`` between, null as empty), divided into an exponential variate by ``weight`` if
    one is given; the rows of smallest priority are taken, so rows of large weight come
    oftener. ``out`` is the stratum's rows over those taken; with a weight,
    ``1 / (1 - exp(-weight * t))`` with the smallest priority ``t`` not taken (1 if all
    are). Sums of a value times ``out`` then estimate the sum of all rows without bias.

    ``key`` should identify a row: rows of equal keys have equal priorities and are taken
    in the order of a hash of the row. A null is a stratum of its own. ``n`` may be a
    ``{stratum: n}`` dict for one ``strata`` column; strata not listed are dropped. Rows whose
    weight is missing, not above 0 or infinite are never taken or counted.

    One scan counts priorities in fine bins for each stratum, which gives the bin that
    holds the last row taken. Rows of lower bins are taken as they are read; only those
    of that one bin (about a thousandth of the sample) are ranked.
    """
    strata = [strata] if isinstance(strata, str) else list(strata)
    keys = [key] if isinstance(key, str) else list(key)
    if isinstance(n, Mapping) and len(strata) != 1:
        raise ValueError("a size per stratum needs one strata column")
    if min(n.values() if isinstance(n, Mapping) else [n], default=1) < 1:
        raise ValueError("n must be at least 1")
    if out in df.columns:
        raise ValueError(f"there is a column {out!r} already: name another one as out")
    by = [quoted(s) for s in strata]
    row = F.struct(*[quoted(c) for c in df.columns]).alias("_bp_row")
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys])
    priority = (F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = df
    if weight is not None:
        w = quoted(weight).cast("double")
        rows = rows.where((w > 0) & (w < float("inf")))
        priority = -F.log(priority) / w
    if isinstance(n, Mapping):
        sizes = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])
        size = F.try_element_at(sizes, by[0])
        rows = rows.where(size.isNotNull())
    else:
        size = F.lit(n)
    rows = rows.select(
        *by, row, row_hash(df).alias("_bp_h"), priority.alias("_bp_p"), size.cast("bigint").alias("_bp_k"),
        (F.lit(0.0) if weight is None else w).alias("_bp_w"),
    )
    place = F.when(F.col("_bp_p") > 0, F.log2("_bp_p") * _BINS_A_DOUBLING).otherwise(-_END_BIN)
    rows = rows.withColumn("_bp_bin", F.floor(F.least(F.greatest(place, F.lit(-_END_BIN)), F.lit(_END_BIN))).cast("int"))

    last, single = _last_bins(rows, strata)
    ranked, taken_at = _placed(rows, last, strata, single), F.col("_bp_before") + F.col("_bp_rank")
    small = F.col("_bp_all") <= F.col("_bp_k")
    if weight is None:
        stands = F.when(small, 1.0).otherwise(F.col("_bp_all") / F.col("_bp_k"))
    else:
        # the smallest priority not taken: one row a stratum
        next_one = _edge(rows, last, strata, single).where(taken_at == F.col("_bp_k") + 1)
        if single:
            found = next_one.first()
            limit = F.lit(found["_bp_p"] if found else None).cast("double")
        else:
            limits, _ = broadcast_if_small(next_one.select(*by, F.col("_bp_p").alias("_bp_limit")))
            ranked, limit = null_safe_join(ranked, limits, strata, "left"), F.col("_bp_limit")
        stands = F.when(small, 1.0).otherwise(-1 / F.expm1(-F.col("_bp_w") * limit))
    chosen = ranked.where(small | (taken_at <= F.col("_bp_k")))
    return chosen.select(*[F.col("_bp_row").getField(c).alias(c) for c in df.columns], stands.alias(out))


def _last_bins(rows: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, bool]:
    """For each stratum its rows, the bin of the first row not taken, and the rows before
    that bin. The row after the last taken is in the same bin or a later one."""
    by = [quoted(s) for s in strata]
    bins = rows.groupBy(*by, "_bp_bin").agg(F.count(F.lit(1)).alias("_bp_c"), F.max("_bp_k").alias("_bp_size"))
    order = Window.partitionBy(*by).orderBy("_bp_bin")
    earlier = F.sum("_bp_c").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_bp_c").over(Window.partitionBy(*by))
    bins = bins.withColumn("_bp_before", F.coalesce(earlier, F.lit(0))).withColumn("_bp_all", total)
    after = F.col("_bp_size") + 1  # the row whose bin is wanted
    held = (F.col("_bp_before") < after) & (after <= F.col("_bp_before") + F.col("_bp_c"))
    only = (F.col("_bp_all") <= F.col("_bp_size")) & (F.col("_bp_before") == 0)  # all rows are taken
    found = bins.where(held | only).select(*by, "_bp_before", "_bp_all", F.col("_bp_bin").alias("_bp_last"))
    if strata:
        return broadcast_if_small(found)[0], False
    return measured(found)[0], True


def _with_last(rows: DataFrame, last: DataFrame, strata: Sequence[str], single: bool) -> DataFrame:
    if not single:
        return null_safe_join(rows, last, strata, "inner")
    found = last.first()  # one row of three numbers: constants
    names = ("_bp_before", "_bp_all", "_bp_last")
    return rows.withColumns({c: F.lit(found[c] if found else None).cast("bigint") for c in names})


def _edge(rows: DataFrame, last: DataFrame, strata: Sequence[str], single: bool) -> DataFrame:
    """The rows of the strata's last bins with their rank in it, from 1."""
    edge = _with_last(rows, last, strata, single).where(F.col("_bp_bin") == F.col("_bp_last"))
    order = Window.partitionBy(*[quoted(s) for s in strata], "_bp_bin").orderBy("_bp_p", "_bp_h")
    return edge.withColumn("_bp_rank", F.row_number().over(order))


def _placed(rows: DataFrame, last: DataFrame, strata: Sequence[str], single: bool) -> DataFrame:
    """All rows that may be taken: those of lower bins at rank 0 of the last one, those of
    the last one ranked, and every row of a stratum that is taken whole."""
    every = _with_last(rows, last, strata, single)
    whole = F.col("_bp_all") <= F.col("_bp_k")
    sure = every.where(whole | (F.col("_bp_bin") < F.col("_bp_last")))
    sure = sure.withColumn("_bp_before", F.lit(0).cast("bigint")).withColumn("_bp_rank", F.lit(0))
    return sure.unionByName(_edge(rows, last, strata, single).where(~whole))
