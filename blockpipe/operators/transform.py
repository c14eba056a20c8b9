"""Single-dataset transformation blocks (D1-D11)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockpipe.functions import as_column, present, quoted
from blockpipe.operators.widepca import block_pca
from blockpipe.plans.ranking import WINDOW_MAX_GROUP_ROWS, largest_group, quantiles, rank_within, row_hash


# --- D1-D3: time and text -------------------------------------------------------


def _utc_clock(instant: Column) -> Column:
    """The clock time of an instant in UTC, whatever the session's zone is."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _parsed_clock(c: Column, fmt: str) -> Column:
    bare = re.sub(r"'[^']*'", "", fmt)
    if re.search(r"[VzOXxZ]", bare):  # the text names its own zone
        return _utc_clock(F.try_to_timestamp(c, F.lit(fmt)))
    return _utc_clock(F.try_to_timestamp(F.concat(c, F.lit(" +00:00")), F.lit(fmt + " XXX")))


def parse_time(
    df: DataFrame, col: str, fmt: str | Sequence[str] | None = None, out: str | None = None
) -> DataFrame:
    """Text to ``timestamp_ntz``; text that does not parse becomes null.
    ``fmt`` may list several patterns: the first that parses a value wins. Clock
    times stay as written; text that names a zone is turned into UTC. Neither
    depends on the session's time zone."""
    c = quoted(col).cast("string")
    if fmt is None:
        zoned = c.rlike(r"(?i)\d{1,2}:.*(Z|[+-]\d{1,2}(:?\d{2})?|\[?[A-Z]+/[A-Z_]+\]?|\b(UTC|GMT)\S*)\s*$")
        parsed = F.when(zoned, _utc_clock(c.try_cast("timestamp"))).otherwise(c.try_cast("timestamp_ntz"))
    else:
        fmts = [fmt] if isinstance(fmt, str) else list(fmt)
        parsed = F.coalesce(*[_parsed_clock(c, f) for f in fmts])
    return df.withColumn(out or col, parsed)


TIME_UNITS = ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND")


def years_between(df: DataFrame, col: str, as_of, out: str = "age", unit: str = "YEAR") -> DataFrame:
    """Whole ``unit``s (years by default: an age) from ``col`` to ``as_of``
    (a timestamp, date text or column). ``as_of`` is required: "now" would
    make the block unrepeatable."""
    unit = unit.upper()
    if unit not in TIME_UNITS:
        raise ValueError(f"unit must be one of {TIME_UNITS}, got {unit!r}")
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return df.withColumn(out, F.timestamp_diff(unit, quoted(col), ref))


def split_column(
    df: DataFrame,
    col: str,
    into: Sequence[str],
    sep: str = " ",
    drop: bool = False,
    keep_rest: bool = True,
) -> DataFrame:
    """Split ``col`` on the literal ``sep`` into the columns ``into``;
    missing or empty parts are null. Parts beyond ``len(into)`` stay joined in the
    last column; ``keep_rest=False`` drops them."""
    limit = len(into) if keep_rest else -1
    literal = "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(quoted(col), literal, limit)
    new = {name: F.nullif(F.get(parts, i), F.lit("")) for i, name in enumerate(into)}
    out = df.withColumns(new)
    return out.drop(col) if drop and col not in into else out


# --- D4: smoothing ---------------------------------------------------------------


def smooth(
    df: DataFrame,
    col: str,
    partition_by: Sequence[str] | str,
    order_by: Sequence[str | Column] | str,
    window: int = 3,
    out: str | None = None,
    method: str = "auto",
    chunk_rows: int | None = None,
    max_group_rows: int = WINDOW_MAX_GROUP_ROWS,
    min_periods: int = 1,
) -> DataFrame:
    """Moving average of ``col`` over the current row and the ``window - 1``
    rows before it, per ``partition_by`` in ``order_by`` order. The average
    is null where the window holds fewer than ``min_periods`` non-missing
    values (``min_periods=window`` is pandas ``rolling(window).mean()``).

    ``method="auto"`` (default) measures the largest group first and uses
    the plain window when it has at most ``max_group_rows`` rows (one task
    sorts one group), the ranked plan otherwise.

    ``method="ranked"`` is skew-safe. Rows get their exact position
    in their group (``rank_within``: range partitioning cuts a hot group into
    many tasks). Positions are cut into chunks of ``chunk_rows`` (default
    ``max(64 * window, 65536)``); a window per (group, chunk) is one balanced
    shuffle whatever the group sizes. The last ``window - 1`` rows of a
    chunk (a ``(window - 1) / chunk_rows`` share of the data) are copied to the
    next one, so every row's window holds the same rows in the same order as the
    plain window: both plans give equal averages, bit for bit.
    ``method="window"`` is the plain window function, cheaper when no group
    is large.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    order = [quoted(o) if isinstance(o, str) and o in df.columns else o for o in order]
    order = [*order, row_hash(df)]  # rows tied in the given order come in one order in every run and plan
    out = out or col
    if window < 1:
        raise ValueError("window must be at least 1")
    if not 1 <= min_periods <= window:
        raise ValueError("min_periods must be between 1 and window")
    if method == "auto":
        method = "window" if largest_group(df, keys) <= max_group_rows else "ranked"
    if method == "window":
        from pyspark.sql import Window

        w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*[as_column(o) for o in order]).rowsBetween(-window + 1, 0)
        v = present(df, col)
        return df.withColumn(out, F.when(F.count(v).over(w) >= min_periods, F.avg(v).over(w)))
    if method != "ranked":
        raise ValueError(f"method must be 'auto', 'ranked' or 'window', got {method!r}")
    from pyspark.sql import Window

    size = chunk_rows or max(64 * window, 65536)
    if size < window:
        raise ValueError("chunk_rows must be at least the window")
    ranked = rank_within(df, keys, order, pos_col="_bp_pos")
    own = F.floor(F.col("_bp_pos") / size)
    # a chunk's last rows also lead the next chunk, for the windows of its first rows
    leads = F.col("_bp_pos") - own * size >= size - (window - 1)
    placed = ranked.withColumn("_bp_own", own).withColumn(
        "_bp_chunk", F.explode(F.when(leads, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*[quoted(k) for k in keys], "_bp_chunk").orderBy("_bp_pos").rowsBetween(-window + 1, 0)
    v = present(df, col)
    averaged = placed.withColumn("_bp_avg", F.when(F.count(v).over(w) >= min_periods, F.avg(v).over(w)))
    averaged = averaged.where(F.col("_bp_own") == F.col("_bp_chunk")).withColumn(out, F.col("_bp_avg"))
    return averaged.select(*[quoted(c) for c in df.columns], *([quoted(out)] if out not in df.columns else []))


# --- D5: outliers ----------------------------------------------------------------


def outlier_bounds(
    df: DataFrame,
    col: str,
    method: str = "iqr",
    k: float | None = None,
    approx: bool = False,
    quantile_method: str = "auto",
) -> DataFrame:
    """One row ``(lower, upper)``: values outside are outliers."""
    if method == "iqr":
        k = 1.5 if k is None else k
        q = quantiles(df, present(df, col), [0.25, 0.75], names=["q1", "q3"], approx=approx,
                      method=quantile_method)
        iqr = F.col("q3") - F.col("q1")
        return q.select((F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))
    if method == "zscore":
        k = 3.0 if k is None else k
        s = df.agg(F.avg(present(df, col)).alias("m"), F.stddev_samp(present(df, col)).alias("s"))
        return s.select((F.col("m") - k * F.col("s")).alias("lower"), (F.col("m") + k * F.col("s")).alias("upper"))
    raise ValueError(f"method must be 'iqr' or 'zscore', got {method!r}")


def drop_outliers(
    df: DataFrame,
    col: str,
    method: str = "iqr",
    k: float | None = None,
    approx: bool = False,
    quantile_method: str = "auto",
) -> DataFrame:
    """Drop rows whose ``col`` lies outside the bounds (Tukey fences or
    ``|z| <= k``). Rows with a missing value are not outliers and stay. The
    bounds are one row, used as scalar subqueries: computed once, then
    constants in the filter (no join)."""
    bounds = outlier_bounds(df, col, method, k, approx, quantile_method)
    lower, upper = bounds.select("lower").scalar(), bounds.select("upper").scalar()
    v = present(df, col)
    return df.where(v.isNull() | ((v >= lower) & (v <= upper)))


# --- D6: aggregation ---------------------------------------------------------------


def aggregate(
    df: DataFrame,
    keys: Sequence[str] | str,
    aggs: Mapping[str, tuple[str, str] | Column],
) -> DataFrame:
    """Summaries per key: ``{out: (function name, column)}`` or ``{out: Column}``.
    Catalyst plans a partial (map-side) and a final aggregation."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if set(keys) & set(aggs):
        raise ValueError(f"a summary is named like a key: {sorted(set(keys) & set(aggs))}")
    exprs = []
    for name, spec in aggs.items():
        if isinstance(spec, Column):
            e = spec
        else:
            fn, c = spec
            arg = F.lit(1) if c == "*" else quoted(c)
            e = getattr(F, fn)(arg)
        exprs.append(e.alias(name))
    return df.groupBy(*[quoted(k) for k in keys]).agg(*exprs)


# --- D7: discretization --------------------------------------------------------------


def discretize(
    df: DataFrame,
    col: str,
    method: str = "width",
    n: int = 5,
    edges: Sequence[float] | None = None,
    out: str = "bin",
    approx: bool = False,
    quantile_method: str = "auto",
    closed: str = "left",
) -> DataFrame:
    """Continuous values to interval numbers ``0 .. n-1``.

    ``width``: ``n`` equal-width bins between min and max, ``[a, b)`` with
    the maximum in the last bin (``closed="left"``), or ``(a, b]`` with the
    minimum in the first bin (``closed="right"``, as pandas ``cut``).
    ``quantile``: bin = number of the ``n - 1`` inner quantile edges below
    the value (as pandas ``qcut``). ``edges``: the same with given edges. Statistics are scalar subqueries (one row,
    computed once, then constants); there is no global sort or ``ntile``.
    """
    v = present(df, col).cast("double")
    if method == "width":
        lo, hi = df.select(F.min(v)).scalar(), df.select(F.max(v)).scalar()
        span = hi - lo
        if closed == "left":
            raw = F.floor((v - lo) / span * n).cast("bigint")
        elif closed == "right":
            raw = F.greatest(F.ceil((v - lo) / span * n).cast("bigint") - 1, F.lit(0).cast("bigint"))
        else:
            raise ValueError(f"closed must be 'left' or 'right', got {closed!r}")
        binned = F.when(span == 0, F.lit(0).cast("bigint")).otherwise(F.least(raw, F.lit(n - 1).cast("bigint")))
        return df.withColumn(out, F.when(v.isNotNull(), binned))
    if method == "quantile":
        probs = [i / n for i in range(1, n)]
        names = [f"_bp_e{i}" for i in range(len(probs))]
        q = quantiles(df, v, probs, names=names, approx=approx, method=quantile_method)
        cuts = [q.select(nm).scalar() for nm in names]
    elif method == "edges":
        if not edges:
            raise ValueError("method='edges' needs edges")
        cuts = [F.lit(float(e)) for e in sorted(edges)]
    else:
        raise ValueError(f"method must be 'width', 'quantile' or 'edges', got {method!r}")
    count_below = F.lit(0).cast("bigint")
    for cut in cuts:
        count_below = count_below + F.when(cut < v, 1).otherwise(0)
    return df.withColumn(out, F.when(v.isNotNull(), count_below))


# --- D8: attribute construction ----------------------------------------------------------


def construct(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """New attributes from existing ones: ``{out: SQL text or Column}``."""
    return df.withColumns({k: (F.expr(v) if isinstance(v, str) else v) for k, v in exprs.items()})


# --- D9: data reduction --------------------------------------------------------------------

_HASH_BUCKETS = 1 << 20


def reduce_rows(
    df: DataFrame,
    fraction: float | Mapping,
    key: Sequence[str] | str,
    strata: str | None = None,
    seed: int = 0,
    method: str = "hash",
    modulus: int | None = None,
) -> DataFrame:
    """Keep a repeatable share of rows, chosen by ``key``.

    ``method="hash"``: keep rows whose first 20 bits of ``md5("seed|key|...")``
    are below ``fraction * 2^20`` (keys as text, null as empty); the same keys
    survive in every run, and in any engine that has md5. ``fraction`` may be a ``{stratum: fraction}`` dict with
    ``strata`` naming the column (stratified; strata not listed are dropped).
    ``method="modulo"``: systematic sample of an integral key, keeping
    ``pmod(key + seed, modulus) < fraction * modulus``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if isinstance(fraction, Mapping):
        if not strata:
            raise ValueError("a fraction per stratum needs the strata column")
        frac = F.try_element_at(
            F.create_map(*[F.lit(x) for kv in fraction.items() for x in (kv[0], float(kv[1]))]),
            quoted(strata),
        )
    else:
        frac = F.lit(float(fraction))
    if method == "hash":
        text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys])
        bucket = F.conv(F.left(F.md5(text), F.lit(5)), 16, 10).cast("int")
        keep = bucket < frac * _HASH_BUCKETS
    elif method == "modulo":
        if len(keys) != 1 or not modulus:
            raise ValueError("method='modulo' needs one integral key and a modulus")
        keep = F.pmod(quoted(keys[0]) + seed, F.lit(modulus)) < frac * modulus
    else:
        raise ValueError(f"method must be 'hash' or 'modulo', got {method!r}")
    return df.where(F.coalesce(keep, F.lit(False)))


# --- D10: feature selection --------------------------------------------------------------------


def feature_scores(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """``(feature, variance, corr, null_share)``: one aggregation over all
    features, turned into one row per feature."""
    aggs = [F.count(F.lit(1)).alias("_bp_n")]
    for i, f in enumerate(features):
        v = present(df, f).cast("double")
        aggs.append(F.var_samp(v).alias(f"_bp_var{i}"))
        aggs.append(F.count(v).alias(f"_bp_cnt{i}"))
        if target:
            # corr() divides by zero (an ANSI error) for a constant column;
            # this form gives null instead
            t = present(df, target).cast("double")
            both = v.isNotNull() & t.isNotNull()
            x, y = F.when(both, v), F.when(both, t)
            corr = F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))
            aggs.append(corr.alias(f"_bp_corr{i}"))
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"_bp_var{i}").alias("variance"),
                (F.col(f"_bp_corr{i}") if target else F.lit(None).cast("double")).alias("corr"),
                (1 - F.try_divide(F.col(f"_bp_cnt{i}"), F.col("_bp_n"))).alias("null_share"),
            )
            for i, f in enumerate(features)
        ]
    )
    return one.select(F.inline(rows))


def select_features(
    df: DataFrame,
    features: Sequence[str],
    target: str | None = None,
    min_variance: float = 0.0,
    top_k: int | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Score features, keep those with variance above ``min_variance`` and,
    with ``top_k``, the ``top_k`` with the largest ``|corr|`` to ``target``.
    Returns ``(scores, reduced frame)``. Only the score table (one row per
    feature) reaches the driver, to choose the columns."""
    scores = feature_scores(df, features, target)
    rows = scores.collect()
    chosen = [r.feature for r in rows if r.variance is not None and r.variance > min_variance]
    if top_k is not None and target:
        by_corr = {r.feature: abs(r.corr) if r.corr is not None else -1.0 for r in rows}
        chosen = sorted(chosen, key=lambda f: (-by_corr[f], features.index(f)))[:top_k]
        chosen = [f for f in features if f in chosen]
    cols = list(keep) + [f for f in chosen if f not in keep] + ([target] if target and target not in keep else [])
    return scores, df.select(*cols)


# --- D11: feature extraction ----------------------------------------------------------------------


def extract_features(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "scale",
    k: int = 2,
    out: str = "pca",
    ddof: int = 1,
    solver: str | None = None,
) -> DataFrame:
    """Simpler numeric form of ``cols``.

    ``scale``: z-scores with the sample (``ddof=1``, pandas) or population
    (``ddof=0``) standard deviation; ``minmax``: to ``[0, 1]`` (statistics
    as scalar subqueries, merged into one aggregation). ``pca``: the scores on the first ``k`` principal
    components of the centered columns, as an array column ``out``. The
    means come from one aggregation; the covariance of up to ``PCA_PLAIN_COLS`` columns from
    another, of up to ``PCA_SQUARE_COLS`` from Spark ML's PCA (a tree aggregation of
    vectors; the ``len(cols)``-square covariance reaches the driver), and the
    projection is a column expression. Wider tables take ``solver="block"`` (see
    ``operators.widepca``), which holds a few vectors of ``len(cols)`` and no square. ``solver`` (``"plain"``,
    ``"square"``, ``"block"``) forces one. Rows with a missing value are
    left out of the fit and get null scores. Each component's sign is fixed
    so that its largest loading is positive.
    """
    cols = list(cols)
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    if method in ("scale", "minmax"):
        # scalar subqueries over one source: Spark merges them into one aggregation
        scaled = {}
        for c in cols:
            v = present(df, c).cast("double")
            if method == "scale":
                std = F.stddev_samp(v) if ddof == 1 else F.stddev_pop(v)
                a, b = df.select(F.avg(v)).scalar(), df.select(std).scalar()
            else:
                a, b = df.select(F.min(v)).scalar(), df.select(F.max(v) - F.min(v)).scalar()
            scaled[c] = F.when(b != 0, (v - a) / b)
        return df.withColumns(scaled)
    if method == "pca":
        return _pca(df, cols, k, out, solver)
    raise ValueError(f"method must be 'scale', 'minmax' or 'pca', got {method!r}")


# Columns whose sums of products are plain aggregates of one row.
PCA_PLAIN_COLS = 16
# Columns whose square covariance may reach the driver (8 MB).
PCA_SQUARE_COLS = 1024


def _pca(df: DataFrame, cols: Sequence[str], k: int, out: str, solver: str | None) -> DataFrame:
    import numpy as np

    d = len(cols)
    if not 1 <= k <= d:
        raise ValueError(f"k must be between 1 and {d}")
    solver = solver or ("plain" if d <= PCA_PLAIN_COLS else "square" if d <= PCA_SQUARE_COLS else "block")
    if solver not in ("plain", "square", "block"):
        raise ValueError(f"solver must be 'plain', 'square' or 'block', got {solver!r}")
    if solver == "block":
        return block_pca(df, [quoted(c).cast("double") for c in cols], k, out)
    values = [present(df, c).cast("double") for c in cols]
    missing = reduce(Column.__or__, [v.isNull() for v in values])
    row = df.where(~missing).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    if row is None or row["m0"] is None:  # no complete row
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    means = [row[f"m{i}"] for i in range(d)]
    fit = _plain_components if solver == "plain" else _ml_components
    comps = fit(df.where(~missing), values, means, k)  # len(cols) by k
    for j in range(k):
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] = -comps[:, j]
    # a missing value makes every score null
    if solver == "plain":
        centred = [v - m for v, m in zip(values, means)]
        scores = [sum((x * float(w) for x, w in zip(centred, comps[:, j])), F.lit(0.0)) for j in range(k)]
        return df.withColumn(out, F.array(*[F.when(~missing, s) for s in scores]))
    vector = F.zip_with(F.array(*values), F.lit(means), lambda x, m: x - m)
    scores = [
        F.aggregate(F.zip_with("_bp_v", F.lit(comps[:, j].tolist()), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        for j in range(k)
    ]
    unknown = F.exists("_bp_v", lambda x: x.isNull())
    scored = df.withColumn("_bp_v", vector)
    return scored.withColumn(out, F.array(*[F.when(~unknown, s) for s in scores])).drop("_bp_v")


def _plain_components(df: DataFrame, values: Sequence[Column], means: Sequence[float], k: int):
    """Eigenvectors of the centred columns' products, summed in one aggregation."""
    import numpy as np

    d = len(values)
    centred = [v - m for v, m in zip(values, means)]
    sums = df.agg(*[F.sum(centred[i] * centred[j]) for i in range(d) for j in range(i, d)]).first()
    products = np.zeros((d, d))
    products[np.triu_indices(d)] = sums
    _, vectors = np.linalg.eigh(products, UPLO="U")
    return vectors[:, ::-1][:, :k].copy()


def _ml_components(df: DataFrame, values: Sequence[Column], means: Sequence[float], k: int):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    centred = F.zip_with(F.array(*values), F.lit(list(means)), lambda x, m: x - m)
    fitted = PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector(centred).alias("v")))
    return fitted.pc.toArray().copy()
