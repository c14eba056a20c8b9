"""Feature selection by mutual information (D10): relations of any shape between a
feature and the target, and between features, from one scan of binned counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from blockpipe.functions import present, quoted

# A feature of whose entropy a chosen one tells this share has nothing to add.
KNOWN_SHARE = 0.999


def _bins(df: DataFrame, cols: Sequence[str], bins: int) -> list[Column]:
    """The bin of each column's value, -1 for a missing one. The ends of the numbers'
    ranges are two constants a column, from one aggregation."""
    texts = [isinstance(df.schema[c].dataType, StringType) for c in cols]
    numbers = [None if t else present(df, c).cast("double") for c, t in zip(cols, texts)]
    infinite = float("inf")
    ends = []
    for i, v in enumerate(numbers):
        if v is not None:
            finite = F.when(F.abs(v) < infinite, v)
            ends += [F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
    found = df.agg(*ends).first().asDict() if ends else {}
    out = []
    for i, (c, v) in enumerate(zip(cols, numbers)):
        if v is None:
            place = F.conv(F.left(F.md5(quoted(c)), F.lit(8)), 16, 10).cast("bigint") % bins
        else:
            lo, hi = found[f"lo{i}"], found[f"hi{i}"]
            if lo is None or lo == hi:
                inside = F.lit(0).cast("bigint")
            else:
                step = F.floor(F.when(F.abs(v) < infinite, (v - lo) / (hi - lo) * bins)).cast("bigint")
                inside = F.least(step, F.lit(bins - 1).cast("bigint"))
            place = F.when(v == infinite, bins).when(v == -infinite, -2).when(v.isNotNull(), inside)
        out.append(F.coalesce(place.cast("int"), F.lit(-1)))
    return out


def mutual_information(df: DataFrame, cols: Sequence[str], bins: int = 16) -> DataFrame:
    """``(a, b, information)`` in nats for every pair of ``cols`` in their order, each with
    itself too (its entropy).

    Numbers and booleans fall into ``bins`` equal steps between their smallest and
    largest finite value (infinite ones apart), texts into ``bins`` by a hash; missing values
    are a bin. One scan counts the pairs' bins with map-side combine, so at most
    ``len(cols)**2 / 2 * (bins + 3)**2`` counts leave a task, whatever the rows.
    An empty table has no rows here.
    """
    cols = list(cols)
    if bins < 2 or len(set(cols)) != len(cols):
        raise ValueError("at least 2 bins, and each column once")
    placed = df.select(F.array(*_bins(df, cols, bins)).alias("p"))
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("p")[i].alias("x"), F.col("p")[j].alias("y"))
        for i in range(len(cols)) for j in range(i, len(cols))
    ])
    counts = placed.select(F.inline(pairs)).groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def total(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy("i", "j", *keys)).cast("double")

    n = F.col("n").cast("double")
    parts = counts.select("i", "j", (n / total()).alias("share"), (n * total() / (total("x") * total("y"))).alias("lift"))
    found = parts.groupBy("i", "j").agg(F.sum(F.col("share") * F.log("lift")).alias("information"))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "information")


def select_informative(
    df: DataFrame, features: Sequence[str], target: str, top_k: int, bins: int = 16, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The up to ``top_k`` features that tell most about ``target`` without repeating each
    other: ``(table of mutual_information, reduced frame)``.

    The first tells most about the target; each next one has the largest information on
    the target less its mean information on those chosen (ties: the earlier in
    ``features``). A feature of which a chosen one already tells 99.9 %, as a copy in any
    scale, and a constant, are left out. Only the table (a row for each pair of columns)
    reaches the driver. The frame has ``keep``, the chosen features in the order of
    ``features``, and the target.
    """
    features = list(features)
    table = mutual_information(df, [*features, target], bins)
    told: dict[tuple[str, str], float] = {}
    for r in table.collect():
        told[r.a, r.b] = told[r.b, r.a] = r.information
    chosen: list[str] = []
    left = [f for f in features if told.get((f, f), 0.0) > 0]
    while left and len(chosen) < top_k:
        def gain(f: str) -> float:
            return told[f, target] - (math.fsum(told[f, c] for c in chosen) / len(chosen) if chosen else 0.0)

        best = max(left, key=lambda f: (gain(f), -features.index(f)))
        chosen.append(best)
        left = [f for f in left if f != best and told[f, best] < KNOWN_SHARE * told[f, f]]
    cols = [*keep, *[f for f in features if f in chosen and f not in keep], *([] if target in keep else [target])]
    return table, df.select(*[quoted(c) for c in cols])
