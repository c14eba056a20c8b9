"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockpipe.plans.sizing import broadcast_if_small
from blockpipe.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage in a way that survives lost executors, and fixes rows that
    two later steps must see alike."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that extra columns of the input can neither
    clash with an operator's own names nor be moved about."""
    return df.select(*[df[c] for c in columns])


def one_text(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, text): one row for each key, with the text of the smallest digest;
    null only if all are. Copies meet in a grouped minimum, first in their own task."""
    digest = F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text), F.col(text).alias(text)))
    return df.groupBy(*keys).agg(F.min(digest).alias("__least")).select(*keys, F.col(f"__least.{text}").alias(text))


def crc32_of_id(id_col: Column) -> Column:
    """crc32 of the id written as text; the folds of the classifiers use it."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def dealt_in_blocks(rows: DataFrame, keys: list[str], spread: Column, block: int) -> DataFrame:
    """``rows`` with ``__i``, ``__j`` and ``__own``: rows of one key meet in cells
    (key, i, j), every two of them in exactly one.

    A key of at most ``block`` rows is the cell (0, 0). A bigger one is cut by
    ``spread`` into blocks of about that many rows; a row of block b goes to the cells
    of b with every block, so in a cell with i < j only rows of different ``__own``
    are to be compared, and no task holds more than two blocks however many rows
    share the key. Big keys are at most rows / block; their table is broadcast when
    measured small."""
    big = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    big, _ = broadcast_if_small(big)
    blocks = F.coalesce(F.ceil(F.col("__n") / block), F.lit(1)).cast("int")
    out = rows.join(big, keys, "left").withColumn("__blocks", blocks)
    out = out.withColumn("__own", F.pmod(spread, F.col("__blocks")).cast("int"))
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return out.withColumns(
        {"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}
    ).drop("__n", "__blocks", "__other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of equal (non-null) keys,
    ``least_rows`` rows each but for the last one and the group that fills it up."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        first = tuple(v[0] for v in values)
        change[0] = last is not None and first != last
        last = tuple(v[-1] for v in values)
        cuts = np.flatnonzero(change)
        if len(cuts) and rows + int(cuts[-1]) >= least_rows:
            at = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, rows = [batch.slice(at)], batch.num_rows - at
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
