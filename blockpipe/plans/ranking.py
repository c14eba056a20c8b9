"""Skew-safe ordered statistics: position within a group, exact quantiles, mode.

A window ``PARTITION BY key ORDER BY v`` or an exact ``percentile`` sends every
row (or every distinct value) of one key to one task. When one key holds a third
of the rows, that task does a third of the work. The helpers here never do:

* ``rank_within`` range-partitions on ``(keys, order)``, so a hot key is cut
  into many partitions by its order values. Each partition is sorted locally;
  a row's position is its offset inside its partition's slice of the key plus
  the row count of that key in all earlier partitions. The per-(partition, key)
  counts form a table of at most ``partitions + keys`` rows, broadcast when
  its measured size allows (``plans.sizing``). The numbered rows
  are checkpointed to the shared checkpoint folder before they are used twice:
  range bounds come from sampling, so two evaluations of the exchange (or a
  re-run after a lost executor) could cut the data differently.
* ``quantiles`` narrows the range of values around the two ranks next to
  ``p * (n - 1)``: each scan counts the values of the range in bins (map-side
  combine) and goes on with the bin that holds the ranks, until few enough values are
  left to be gathered. Only counts are shuffled, whatever a group's size. The two
  values are interpolated linearly (pandas / ``quantile_cont``).
* ``group_modes`` counts ``(keys, column, value)`` for several columns in one
  pass with map-side combine, then keeps the top value per key and column
  with a fixed-size ``min(struct)`` buffer.

The ranked plans cost a range shuffle and a checkpoint, which only pays when
a group is too big for one task. ``largest_group`` measures that first (one
aggregation, one number to the driver), and the moving average takes a plain window
below a row threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockpipe.functions import as_column, present, quoted
from blockpipe.functions.columns import in_backticks
from blockpipe.plans.sizing import broadcast_if_small, measured
from blockpipe.session import checkpoint_root

_RID = "_bp_rid"
_PART = "_bp_part"
_SEQ = "_bp_seq"

# A plain window sorts a whole group in one task; bigger groups take the ranked plan.
WINDOW_MAX_GROUP_ROWS = 10_000_000
# Values of a group's narrowed range that one buffer may gather.
GATHERED_VALUES = 200_000
# Bins that a narrowed range is cut into, and bins for each doubling of a value before.
_RANGE_BINS, _BINS_A_DOUBLING = 4096, 8


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group of ``keys`` (all rows without keys): one
    aggregation with map-side combine, a single number to the driver."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("_bp_n"))
    return sizes.agg(F.max("_bp_n")).first()[0] or 0


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row (but for types without one), to order tied rows."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    hashed = [quoted(n) for n, t in kinds.items() if "map<" not in t and "variant" not in t]
    return F.xxhash64(*hashed) if hashed else F.lit(0).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str):
    """Join on ``keys`` treating null = null; one copy of each key column
    (a full join takes the key from whichever side has the row)."""
    if not keys:
        raise ValueError("a null-safe join needs at least one key")
    r = right
    renamed = {}
    for k in keys:
        renamed[k] = f"_bp_r_{k}"
        r = r.withColumnRenamed(k, renamed[k])
    own, other = {k: left[in_backticks(k)] for k in keys}, {k: r[in_backticks(renamed[k])] for k in keys}
    cond = [own[k].eqNullSafe(other[k]) for k in keys]
    joined = left.join(r, on=cond, how=how)
    if how in ("full", "outer", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(own[k], other[k]) for k in keys})
    elif how in ("right", "right_outer"):
        joined = joined.withColumns(other)
    return joined.drop(*renamed.values())


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    pos_col: str = "_pos",
    size_col: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Add ``pos_col``: the 0-based position of each row among rows of its key,
    in ``order_by`` order (ascending, nulls first). ``size_col`` adds the key's
    row count. Ties get distinct positions, like ``row_number``, in the order of a
    hash of the row; they count for the range partitioning too, so rows of one key and
    one order value are cut into many partitions, and equal rows by their place.

    With ``weight`` (a non-negative integer column, e.g. a count of collapsed
    duplicates) a row's position is the total weight of the rows before it,
    and the size is the key's total weight.
    """
    keys = list(keys)
    sort_cols = [quoted(k) for k in keys] + [as_column(o) for o in order_by] + [row_hash(df), F.col(_SEQ)]
    # no fixed count: adaptive execution sizes the range partitions from the
    # data (merging neighbours keeps every partition a contiguous range)
    ranged = (
        df.withColumn(_SEQ, F.monotonically_increasing_id())
        .repartitionByRange(*sort_cols)
        .sortWithinPartitions(*sort_cols)
        .drop(_SEQ)
        # upper 31 bits: partition index; lower 33 bits: row index in the sorted partition
        .withColumn(_RID, F.monotonically_increasing_id())
    )
    checkpoint_root(df.sparkSession)
    ranged = ranged.checkpoint(eager=True).withColumn(_PART, F.shiftright(F.col(_RID), 33))
    amount = F.col(weight) if weight else F.lit(1)
    chunks = ranged.groupBy(_PART, *[quoted(k) for k in keys]).agg(
        F.min(_RID).alias("_bp_start"), F.sum(amount).cast("bigint").alias("_bp_n")
    )
    earlier = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_bp_before", F.coalesce(F.sum("_bp_n").over(earlier), F.lit(0)))
    if size_col:
        chunks = chunks.withColumn(size_col, F.sum("_bp_n").over(Window.partitionBy(*[quoted(k) for k in keys])))
    chunks, _ = broadcast_if_small(chunks.drop("_bp_n"))
    if weight:
        # weight of the earlier rows of the same chunk: a window per
        # (partition, key) slice, whose size the range partitioning bounds
        inside = Window.partitionBy(_PART, *[quoted(k) for k in keys]).orderBy(_RID).rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(amount).over(inside), F.lit(0))
        ranged = ranged.withColumn("_bp_local", local)
    else:
        # rows of a chunk are numbered consecutively
        ranged = ranged.withColumn("_bp_local", F.lit(None).cast("bigint"))
    out = null_safe_join(ranged, chunks, [_PART, *keys], "inner")
    local_pos = F.col("_bp_local") if weight else F.col(_RID) - F.col("_bp_start")
    out = out.withColumn(pos_col, F.col("_bp_before") + local_pos)
    return out.drop(_RID, _PART, "_bp_start", "_bp_before", "_bp_local")


def quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    approx: bool = False,
    accuracy: int = 10000,
    method: str = "auto",
    max_group_rows: int = GATHERED_VALUES,
) -> DataFrame:
    """One row per group of ``by``: the ``probs`` quantiles of ``value``.

    Exact by default (linear interpolation between order statistics, as
    pandas ``quantile`` and DuckDB ``quantile_cont``). Nulls and NaN are
    skipped; -0.0 counts as 0.0. ``method="auto"`` counts the groups' rows, narrows
    the value ranges of groups with more than ``max_group_rows`` until at most so
    many values are left for each quantile, and then gathers what is left: all values
    of a small group (Spark's ``percentile``), the narrowed ranges of a big one. The
    results are the same bit by bit. Every narrowing scans ``df`` once more, so its
    rows must come out alike each time. ``method="narrowed"`` narrows every group
    down to single values, ``"percentile"`` gathers every group whole, and
    ``"ranked"`` numbers the sorted distinct values instead.
    ``approx=True`` uses ``percentile_approx``: one pass, a bounded
    sketch per group, rank error about ``1/accuracy``.
    """
    by = list(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    v = as_column(value).cast("double") + F.lit(0.0)
    base = df.select(*[quoted(k) for k in by], v.alias("_bp_v")).where(
        F.col("_bp_v").isNotNull() & ~F.isnan("_bp_v")
    )
    keys = [quoted(k) for k in by]

    def each(arr: Column, rows: DataFrame) -> DataFrame:
        agg = rows.groupBy(*keys).agg(arr.alias("_bp_q"))
        return agg.select(*keys, *[F.col("_bp_q")[i].alias(nm) for i, nm in enumerate(names)])

    if approx:
        return each(F.percentile_approx("_bp_v", list(probs), accuracy), base)
    if method not in ("auto", "narrowed", "percentile", "ranked"):
        raise ValueError(f"method must be 'auto', 'narrowed', 'percentile' or 'ranked', got {method!r}")
    whole = F.percentile("_bp_v", F.array(*[F.lit(float(p)) for p in probs]))
    if method == "percentile":
        return each(whole, base)
    if method != "ranked":
        gathered = 1 if method == "narrowed" else max_group_rows
        sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bp_n"))
        big, n_big, _ = measured(sizes.where(F.col("_bp_n") > gathered))
        if n_big == 0:
            return each(whole, base)
        found = _narrowed_quantiles(base, big, by, probs, names, gathered)
        if not by:
            return found
        others, _ = broadcast_if_small(big.select(*keys))
        return each(whole, null_safe_join(base, others, by, "left_anti")).unionAll(found)

    # equal values collapse map-side, so neither a hot key nor a hot value
    # concentrates rows; each distinct value covers positions [pos, pos + n)
    distinct = base.groupBy(*by, "_bp_v").agg(F.count(F.lit(1)).alias("_bp_n"))
    ranked = rank_within(distinct, by, ["_bp_v"], pos_col="_bp_pos", size_col="_bp_size", weight="_bp_n")
    last = F.col("_bp_size") - 1
    lo = [F.floor(F.lit(float(p)) * last) for p in probs]
    hi = [F.ceil(F.lit(float(p)) * last) for p in probs]

    def covers(rank: Column) -> Column:
        return (F.col("_bp_pos") <= rank) & (rank < F.col("_bp_pos") + F.col("_bp_n"))

    wanted = F.lit(False)
    for r in lo + hi:
        wanted = wanted | covers(r)
    aggs = []
    for i, p in enumerate(probs):
        aggs += [
            F.max(F.when(covers(lo[i]), F.col("_bp_v"))).alias(f"_bp_lo{i}"),
            F.max(F.when(covers(hi[i]), F.col("_bp_v"))).alias(f"_bp_hi{i}"),
            F.max(F.lit(float(p)) * last - lo[i]).alias(f"_bp_f{i}"),
            F.max(hi[i] - F.lit(float(p)) * last).alias(f"_bp_g{i}"),
        ]
    picked = ranked.where(wanted).groupBy(*by).agg(*aggs)
    out = [
        _between(*[F.col(f"_bp_{x}{i}") for x in ("lo", "hi", "f", "g")]).alias(nm) for i, nm in enumerate(names)
    ]
    return picked.select(*keys, *out)


def _between(low: Column, high: Column, above_low: Column, below_high: Column) -> Column:
    """The same arithmetic as ``percentile``, so all methods give equal numbers."""
    return F.when(low == high, low).otherwise(below_high * low + above_low * high)


def _narrowed_quantiles(
    base: DataFrame, big: DataFrame, by: Sequence[str], probs: Sequence[float], names: Sequence[str], gathered: int
) -> DataFrame:
    """``quantiles`` of the groups in ``big`` (keys and ``_bp_n``, their rows).

    A target is one quantile of one group: its two ranks, and the range ``a``..``b`` of
    values that holds both, with the ``below`` rows under it and the ``c`` rows in it.
    Ranks that fall into two bins are neighbours, so they are the one bin's largest
    value and the other's smallest. ``big`` has at most a row for every ``gathered``
    rows, which bounds the table of targets; it is written each round, the data never.
    """
    keys = [quoted(k) for k in by]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    place = F.col("_bp_t.p") * (F.col("_bp_n") - 1)
    targets = big.withColumn("_bp_t", wanted).select(
        *keys, "_bp_n", F.col("_bp_t.i").alias("_bp_i"), F.floor(place).alias("_bp_lo"), F.ceil(place).alias("_bp_hi"),
        (place - F.floor(place)).alias("_bp_f"), (F.ceil(place) - place).alias("_bp_g"),
        F.lit(0).cast("bigint").alias("_bp_below"), F.col("_bp_n").alias("_bp_c"),
        F.lit(float("-inf")).alias("_bp_a"), F.lit(float("inf")).alias("_bp_b"), F.lit(False).alias("_bp_split"),
    )
    several = ~F.col("_bp_split") & (F.col("_bp_a") < F.col("_bp_b"))
    wide = several & (F.col("_bp_c") > gathered)
    closed = []
    while True:
        targets, _, _ = measured(_narrow(base, targets, by, len(probs)))
        closed.append(targets.where(~wide))
        targets = targets.where(wide)
        if targets.isEmpty():
            break
    targets = closed[0]
    for more in closed[1:]:
        targets = targets.unionAll(more)
    done = targets.where(~several).select(*keys, "_bp_i", "_bp_f", "_bp_g", "_bp_a", "_bp_b")
    rest = targets.where(several)
    if not rest.isEmpty():
        values = _in_ranges(base, rest, by, len(probs)).groupBy(*keys, "_bp_a")
        values = values.agg(F.sort_array(F.collect_list("_bp_v")).alias("_bp_vs"))
        joined = null_safe_join(rest, values, [*by, "_bp_a"], "inner")
        at = [F.get("_bp_vs", (F.col(r) - F.col("_bp_below")).cast("int")) for r in ("_bp_lo", "_bp_hi")]
        done = done.unionAll(joined.select(*keys, "_bp_i", "_bp_f", "_bp_g", at[0], at[1]))
    out = _between(F.col("_bp_a"), F.col("_bp_b"), F.col("_bp_f"), F.col("_bp_g"))
    picks = [F.max(F.when(F.col("_bp_i") == i, out)).alias(nm) for i, nm in enumerate(names)]
    return done.groupBy(*keys).agg(*picks)


def _in_ranges(base: DataFrame, targets: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The rows whose value is in a range of its group's targets, with that range. Ranges
    of a group are equal or have no value in common."""
    own = F.col("_bp_i")
    sides = [F.max(F.when(own == i, F.col(f"_bp_{x}"))).alias(f"_bp_{x}{i}") for i in range(n) for x in "ab"]
    ranges = targets.groupBy(*[quoted(k) for k in by]).agg(*sides)
    if by:
        ranges, _ = broadcast_if_small(ranges)
        rows = null_safe_join(base, ranges, by, "inner")
    else:  # one row of two numbers a quantile: constants
        rows = base.withColumns({k: F.lit(x).cast("double") for k, x in ranges.first().asDict().items()})
    v = F.col("_bp_v")
    ends = [
        F.coalesce(*[F.when(v.between(F.col(f"_bp_a{i}"), F.col(f"_bp_b{i}")), F.col(f"_bp_{x}{i}")) for i in range(n)])
        for x in "ab"
    ]
    rows = rows.select(*[quoted(k) for k in by], v, ends[0].alias("_bp_a"), ends[1].alias("_bp_b"))
    return rows.where(F.col("_bp_a").isNotNull())


def _narrow(base: DataFrame, targets: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """``targets`` with their ranges narrowed to the bins of one more scan.

    Bins grow with the value: first by its sign and logarithm, so no distribution of
    values needs many rounds, then at equal steps between a range's ends, which
    are values themselves, so that every round tells them apart.
    """
    keys = [quoted(k) for k in by]
    v, a, b = F.col("_bp_v"), F.col("_bp_a"), F.col("_bp_b")
    size, most = F.abs(v), 1 << 20
    scale = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * _BINS_A_DOUBLING) + (most >> 1)
    scale = F.when(size == 0, 0).when(size == float("inf"), most).otherwise(scale)
    step = F.least(F.floor((v - a) / (b - a) * _RANGE_BINS), F.lit(_RANGE_BINS - 1))
    number = F.when(a == float("-inf"), F.when(v < 0, -scale).otherwise(scale)).otherwise(step).cast("int")
    rows = _in_ranges(base, targets, by, n).select(*keys, "_bp_a", number.alias("_bp_bin"), "_bp_v")
    bins = rows.groupBy(*keys, "_bp_a", "_bp_bin").agg(
        F.count(F.lit(1)).alias("_bp_k"), F.min("_bp_v").alias("_bp_min"), F.max("_bp_v").alias("_bp_max")
    )
    fixed = [*keys, *[F.col(f"_bp_{x}") for x in ("n", "i", "lo", "hi", "f", "g")]]
    joined = null_safe_join(targets.drop("_bp_b", "_bp_c", "_bp_split"), bins, [*by, "_bp_a"], "inner")
    earlier = Window.partitionBy(*keys, "_bp_i").orderBy("_bp_bin").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_bp_below") + F.coalesce(F.sum("_bp_k").over(earlier), F.lit(0))
    placed = joined.withColumn("_bp_start", start)

    def held(rank: str) -> Column:
        inside = (F.col("_bp_start") <= F.col(rank)) & (F.col(rank) < F.col("_bp_start") + F.col("_bp_k"))
        parts = [F.col(f"_bp_{x}").alias(x) for x in ("bin", "start", "k", "min", "max")]
        return F.max(F.when(inside, F.struct(*parts)))

    found = placed.groupBy(*fixed).agg(held("_bp_lo").alias("_bp_l"), held("_bp_hi").alias("_bp_h"))
    low, high = F.col("_bp_l"), F.col("_bp_h")
    one = low["bin"] == high["bin"]
    return found.select(
        *fixed, low["start"].alias("_bp_below"), low["k"].alias("_bp_c"),
        F.when(one, low["min"]).otherwise(low["max"]).alias("_bp_a"),
        F.when(one, low["max"]).otherwise(high["min"]).alias("_bp_b"), (~one).alias("_bp_split"),
    )


def group_modes(
    df: DataFrame, values: Sequence[str], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Most frequent non-missing value of each column in ``values``, per
    group of ``by``; the smallest value wins a tie.

    One pass for all columns: every row becomes one row per column, holding
    the column's index and its value in that column's typed slot. Counting
    ``(keys, column, value)`` combines copies map-side; the best value per
    ``(keys, column)`` is a fixed-size ``min(struct(-count, value))``; a last
    small aggregation puts the columns side by side.
    """
    by = list(by)
    values = list(values)
    names = list(names) if names else [f"mode_{v}" for v in values]
    if len(values) == 1:
        # one column: count (keys, value) directly, no stacking
        v = present(df, values[0])
        counts = (
            df.where(v.isNotNull())
            .groupBy(*[quoted(k) for k in by], v.alias("_bp_v"))
            .agg(F.count(F.lit(1)).alias("_bp_c"))
        )
        best = F.min(F.struct((-F.col("_bp_c")).alias("c"), F.col("_bp_v").alias("v")))
        return counts.groupBy(*by).agg(best.getField("v").alias(names[0]))
    stacks = []
    for i in range(len(values)):
        slots = [
            (present(df, v) if j == i else F.lit(None).cast(df.schema[v].dataType)).alias(f"v{j}")
            for j, v in enumerate(values)
        ]
        stacks.append(F.struct(F.lit(i).alias("i"), F.struct(*slots).alias("v")))
    stacked = df.select(*[quoted(k) for k in by], F.explode(F.array(*stacks)).alias("_bp_s"))
    stacked = stacked.select(*by, F.col("_bp_s.i").alias("_bp_i"), F.col("_bp_s.v").alias("_bp_v"))
    present_slot = F.lit(False)
    for i in range(len(values)):
        present_slot = present_slot | ((F.col("_bp_i") == i) & F.col("_bp_v").getField(f"v{i}").isNotNull())
    counts = stacked.where(present_slot).groupBy(*by, "_bp_i", "_bp_v").agg(F.count(F.lit(1)).alias("_bp_c"))
    best = counts.groupBy(*by, "_bp_i").agg(
        F.min(F.struct((-F.col("_bp_c")).alias("c"), F.col("_bp_v").alias("v"))).getField("v").alias("_bp_v")
    )
    picks = [
        F.max(F.when(F.col("_bp_i") == i, F.col("_bp_v").getField(f"v{i}"))).alias(name)
        for i, name in enumerate(names)
    ]
    return best.groupBy(*by).agg(*picks)


def group_mode(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent non-missing ``value`` per group; the smallest value wins a tie."""
    return group_modes(df, [value], by, [name])
