"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every block of input rows learns by an exact draw how many of its rows go to each
shard: a row of the communication matrix, whose columns sum to the shard sizes.
Within a block a random permutation decides which rows these are. The rows are
exchanged once, and a random order inside the shard gives their slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockpipe.llm.common import written
from blockpipe.session import scratch_path

BLOCK_ROWS = 16_384
GROUPS = 1_024
SLOT_ROWS = 20_000
DRAW_ROWS = 10**9  # numpy draws from fewer rows than this


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def halved(rng: np.random.Generator, left: np.ndarray) -> np.ndarray:
    """Of each shard's places those with heads if every place tosses a fair coin;
    a sum of draws of at most ``DRAW_ROWS`` tosses."""
    full, rest = np.divmod(left, DRAW_ROWS)
    heads = rng.binomial(rest, 0.5)
    for s in np.flatnonzero(full):
        heads[s] += rng.binomial(DRAW_ROWS, 0.5, full[s]).sum()
    return heads


def drawn_places(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` places, drawn without replacement, each shard gives: a
    multivariate hypergeometric draw. From ``DRAW_ROWS`` places and more every place
    tosses a coin and those with heads are drawn first: they are all in, or all
    of the draw is among them. Either way about half of the places are decided."""
    sure = np.zeros_like(left)
    while left.sum() >= DRAW_ROWS:
        heads = halved(rng, left)
        if heads.sum() <= n:
            sure, left, n = sure + heads, left - heads, n - int(heads.sum())
        else:
            left = heads
    return sure + rng.multivariate_hypergeometric(left, n, method="marginals")


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """One row for each part: how many of its rows go to each shard. Rows sum to
    ``counts``, columns to ``sizes``; each row is a multivariate hypergeometric
    draw from what the shards have left, whatever their number of rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(sizes, dtype=np.int64)
    matrix = []
    for n in counts:
        draw = drawn_places(rng, left, n)
        left -= draw
        matrix.append(draw.tolist())
    return matrix


def _blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """``df``, read from files, with ``__file``, ``__block`` and ``__at``: where a
    row stands in its file, however the files are split over tasks."""
    at = F.col("_metadata.row_index")
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.floor(at / block_rows).cast("long").alias("__block"),
        (at % block_rows).cast("int").alias("__at"),
    )


def shard_rows(
    spark: SparkSession,
    source: str | DataFrame,
    shards: int,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
    groups: int = GROUPS,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """All rows of ``source`` (the path of a Parquet table, or a frame, which is
    first written to the shared folder) plus ``shard`` and ``slot``.

    Shard sizes are at most one row apart (law ``rows``); slots run from 0 without
    gaps; every assignment of rows to places is equally likely.

    The matrix is drawn in two steps, so that nothing grows on the driver: blocks
    of ``block_rows`` rows are hashed into at most ``groups`` groups, the driver
    draws the groups-by-shards matrix, and a task for each group draws the rows of
    its own blocks. A row's shard is then a function of its place in its file, so
    a lost task yields the same rows again. One exchange moves the rows, by shard
    and a random sub-range of the shard: no task holds a whole shard, and copies
    of one text spread like any rows.

    Nulls, empty texts and repeated rows are rows like any other; an empty table
    gives an empty result; columns of the source named ``shard`` or ``slot`` are
    replaced.
    """
    if isinstance(source, DataFrame):
        path = scratch_path(spark, "shard-input")
        source.write.parquet(path)
    else:
        path = source
    df = spark.read.parquet(path)
    df = df.drop("shard", "slot")
    columns = df.columns
    placed = _blocks(df, block_rows)

    # how many rows each block has; only row positions are read
    counts = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"))
    group = F.pmod(F.xxhash64("__file", "__block"), F.lit(groups)).cast("int")
    counts = written(counts.withColumn("group", group), "shard-blocks")
    totals = sorted((r.group, r.n) for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect())
    rows = sum(n for _, n in totals)
    sizes = shard_sizes(rows, shards)
    matrix = communication_matrix([n for _, n in totals], sizes, seed)
    quotas = spark.createDataFrame(
        [(g, row) for (g, _), row in zip(totals, matrix)], "group int, quota array<long>"
    )

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__file", "__block"])
        own = (seed * 1_000_003 + int(pdf["group"].iloc[0]) * 7919 + 1) % 2**63
        drawn = communication_matrix(pdf["n"].tolist(), list(pdf["quota"].iloc[0]), own)
        return pd.DataFrame({"__file": pdf["__file"], "__block": pdf["__block"], "__takes": drawn})

    takes = written(
        counts.join(F.broadcast(quotas), "group")  # at most `groups` rows
        .groupBy("group")
        .applyInPandas(draw, "__file string, __block long, __takes array<int>"),
        "shard-matrix",
    )

    @F.pandas_udf("int")
    def permuted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        key, labels = None, None
        for files, blocks, ats, takes in batches:
            out = np.empty(len(ats), dtype=np.int32)
            names, numbers, at = files.to_numpy(), blocks.to_numpy(), ats.to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                if lo == hi:
                    continue
                if key != (names[lo], numbers[lo]):
                    key = (names[lo], numbers[lo])
                    labels = np.repeat(np.arange(shards, dtype=np.int32), np.asarray(takes.iloc[lo]))
                    words = np.frombuffer(f"{seed}|{key[0]}|{key[1]}".encode(), dtype=np.uint8)
                    np.random.Generator(np.random.PCG64(words.tolist())).shuffle(labels)
                out[lo:hi] = labels[at[lo:hi]]
            yield pd.Series(out)

    labelled = placed.join(takes, ["__file", "__block"]).withColumn(
        "shard", permuted("__file", "__block", "__at", "__takes")
    )
    # the second permutation: order by a random number, in sub-ranges of the shard
    parts = max(1, math.ceil(rows / shards / slot_rows))
    draw64 = F.xxhash64(F.lit(seed), "__file", "__block", "__at")
    labelled = labelled.withColumn("__draw", draw64).withColumn(
        "__part", F.pmod(F.shiftrightunsigned(F.col("__draw"), 20), F.lit(parts)).cast("int")
    )
    sub = labelled.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sub.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__part").orderBy("__draw", "__file", "__block", "__at")
    ranked = labelled.select(*columns, "shard", "__part", F.row_number().over(within).alias("__rank"))
    return ranked.join(starts, ["shard", "__part"]).select(
        *columns, "shard", (F.col("__start") + F.col("__rank") - 1).cast("long").alias("slot")
    )
