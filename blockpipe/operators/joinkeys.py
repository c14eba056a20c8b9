"""Join keys found by their values (for B6 and E2): columns of one dataset whose values
are contained in a unique column of another, whatever the columns are called."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, StringType, TimestampNTZType, TimestampType

from blockpipe.functions import quoted
from blockpipe.session import checkpoint_root

# Entries of a column's theta sketch: 2**12 values, at most 64 KB.
SKETCH_BITS = 12
# How many standard deviations a sketch's count may fall short by chance.
DEVIATIONS = 5.0

SCHEMA = (
    "left_dataset string, left_column string, right_dataset string, right_column string, "
    "left_values bigint, right_values bigint, shared_values bigint, containment double, coverage double"
)


def _kind(dtype: DataType) -> str | None:
    """Columns of one kind can be compared; None for types that make no key."""
    if isinstance(dtype, IntegralType):
        return "integer"
    if isinstance(dtype, StringType):
        return "text"
    if isinstance(dtype, DateType):
        return "date"
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return type(dtype).__name__
    return None


def suggest_joins(
    dfs: Mapping[str, DataFrame],
    min_containment: float = 0.95,
    min_coverage: float = 0.1,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """Pairs of columns to join two datasets on, judged by what the columns hold:
    ``(left_dataset, left_column, right_dataset, right_column, left_values, right_values,
    shared_values, containment, coverage)``.

    The right column is a key: no value of it occurs twice. ``left_values``, ``right_values``
    and ``shared_values`` count distinct values; ``containment`` is the share of the
    left's that the right has, at least ``min_containment``; ``coverage`` the
    share of the right's that the left has, at least ``min_coverage`` (small numbers are
    in every range of ids, but cover little of it). All figures are exact.

    Integers of any width, text, dates and timestamps are compared with their own kind, the
    text case and all; other types are left out. Nulls and empty texts take no part, and a
    column without values has no pair.

    One scan of every dataset makes a theta sketch for each column (2**``sketch_bits`` hashes,
    merged map-side), and pairs of sketches are compared. A pair is dropped if its
    sketches share fewer values than ``DEVIATIONS`` standard deviations below what
    ``min_containment`` or ``min_coverage`` would have them share, or if the right column is
    plainly no key; where a sketch can't tell (few values against very many) the pair
    stays. A second scan of the columns left counts their distinct values and shared
    ones: equal values are first combined where they are, then meet once, in a row that
    holds which columns have them. The driver gets a row for each pair of columns' sketches.
    """
    if not 0 < min_containment <= 1 or not 0 <= min_coverage <= 1:
        raise ValueError("min_containment must be in (0, 1], min_coverage in [0, 1]")
    spark = next(iter(dfs.values())).sparkSession if dfs else SparkSession.getActiveSession()
    columns = [
        (name, f.name, _kind(f.dataType)) for name, df in dfs.items() for f in df.schema.fields if _kind(f.dataType)
    ]
    pairs = _likely_pairs(dfs, columns, min_containment, min_coverage, sketch_bits)
    if not pairs:
        return spark.createDataFrame([], SCHEMA)
    # a row for each pair of columns, held in one, where the pairs find their columns' own
    one = _shared_values(dfs, columns, pairs).agg(F.collect_list(F.struct("a", "b", "n", "most")).alias("all"))
    own = F.transform(F.filter("all", lambda p: p["a"] == p["b"]), lambda p: F.struct(p["a"], p))
    one = one.withColumn("own", F.map_from_entries(own)).withColumn("p", F.explode("all")).where("p.a <> p.b")
    left, right, n = F.col("own")[F.col("p.a")], F.col("own")[F.col("p.b")], F.col("p.n")
    names = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(c).alias("c")) for d, c, _ in columns])
    out = one.where(right["most"] == 1).select(
        names[F.col("p.a")]["d"].alias("left_dataset"), names[F.col("p.a")]["c"].alias("left_column"),
        names[F.col("p.b")]["d"].alias("right_dataset"), names[F.col("p.b")]["c"].alias("right_column"),
        left["n"].alias("left_values"), right["n"].alias("right_values"), n.alias("shared_values"),
        (n / left["n"]).alias("containment"), (n / right["n"]).alias("coverage"),
    )
    return out.where((F.col("containment") >= min_containment) & (F.col("coverage") >= min_coverage))


def _likely_pairs(dfs, columns, min_containment, min_coverage, bits) -> list[tuple[int, int]]:
    """(left, right) column numbers that the sketches don't exclude."""
    parts = []
    for name, df in dfs.items():
        own = [(i, c, kind) for i, (d, c, kind) in enumerate(columns) if d == name]
        if not own:
            continue
        aggs, rows = [], []
        for i, c, kind in own:
            v = _comparable(c, kind)
            aggs += [F.count(v).alias(f"n{i}"), F.theta_sketch_agg(v, bits).alias(f"s{i}")]
            rows.append(
                F.struct(F.lit(i).alias("i"), F.lit(name).alias("d"), F.lit(kind).alias("kind"),
                         F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"))
            )
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    if not parts:
        return []
    sketches = reduce(DataFrame.unionAll, parts).where("n > 0")
    checkpoint_root(sketches.sparkSession)
    sketches = sketches.withColumn("values", F.theta_sketch_estimate("s")).checkpoint(eager=True)
    a, b = sketches.alias("a"), sketches.alias("b")
    met = a.join(b, F.expr("a.kind = b.kind and a.d <> b.d")).select(
        F.col("a.i").alias("a"), F.col("b.i").alias("b"), F.col("a.values").alias("na"), F.col("b.values").alias("nb"),
        F.col("b.n").alias("rows_b"), F.theta_sketch_estimate(F.theta_intersection("a.s", "b.s")).alias("both"),
    )
    size, likely = float(1 << bits), []
    for r in met.collect():  # a row for each pair of columns of one kind
        rate = min(1.0, size / max(r.na, r.nb, 1))  # the share of values that both sketches hold, at least
        seen, exact = r.both * rate, rate == 1.0
        wanted = [min_containment * r.na * rate, min_coverage * r.nb * rate]
        short = any(seen < w - (0 if exact else DEVIATIONS * sqrt(max(w, 1))) - 1e-6 for w in wanted)
        no_key = r.nb < r.rows_b * (1 - DEVIATIONS / sqrt(size))
        if not short and not no_key:
            likely.append((r.a, r.b))
    return likely


def _comparable(name: str, kind: str):
    c = quoted(name)
    if kind == "integer":
        return c.cast("bigint")
    if kind == "text":
        return F.when(c != "", c)
    if kind == "date":
        return F.unix_date(c)
    if kind == "TimestampNTZType":
        return c.cast("string")  # no time zone can make two of them one
    return F.unix_micros(c)


def _shared_values(dfs, columns, pairs) -> DataFrame:
    """(a, b, n, most): distinct values both have, and the most rows one has in a; also for a = b."""
    used = sorted({i for p in pairs for i in p})
    parts = []
    for name, df in dfs.items():
        own = [i for i in used if columns[i][0] == name]
        if own:
            held = [
                F.struct(F.lit(i).alias("i"), F.lit(columns[i][2]).alias("kind"),
                         _comparable(columns[i][1], columns[i][2]).cast("string").alias("v"))
                for i in own
            ]
            rows = df.select(F.inline(F.array(*held))).where("v is not null")
            parts.append(rows.groupBy("kind", "v", "i").agg(F.count(F.lit(1)).alias("n")))
    values = reduce(DataFrame.unionAll, parts)
    held = values.groupBy("kind", "v").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("at"))
    wanted = [*[(i, i) for i in used], *pairs]
    asked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in wanted])
    both = F.filter(asked, lambda p: F.map_contains_key("at", p["a"]) & F.map_contains_key("at", p["b"]))
    met = held.select("at", F.explode(both).alias("p"))
    return met.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.element_at("at", F.col("p.a"))).alias("most")
    )
