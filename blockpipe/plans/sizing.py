"""Broadcast only what has been measured.

Tables derived from the data (per-group statistics, per-partition counts)
have as many rows as there are groups, which nothing bounds in advance. A
planner estimate for such a table is a guess, and adaptive execution decides
only after the big side has already been shuffled. So the derived table is
materialized once (checkpointed to the shared checkpoint folder; it is small
next to the data it summarizes), its bytes are counted, and it is broadcast only
when they fit under ``spark.sql.autoBroadcastJoinThreshold``.
Otherwise it stays a normal join input and Spark shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructField

from blockpipe.functions import quoted
from blockpipe.session import checkpoint_root


def _value_bytes(f: StructField) -> Column:
    """What a value takes: 8 bytes, and for text or nested values what they hold."""
    c = quoted(f.name)
    if isinstance(f.dataType, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(f.dataType, AtomicType):
        return F.lit(8)
    return 64 + 8 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))


def broadcast_limit_bytes(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = raw.strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if raw.endswith(suffix) and raw[: -len(suffix)].strip().lstrip("-").isdigit():
            return int(raw[: -len(suffix)]) * units[suffix]
    return int(raw)


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Materialize ``df`` once; its rows and their bytes, both counted."""
    checkpoint_root(df.sparkSession)
    kept = df.checkpoint(eager=True)
    row = F.lit(16)
    for f in kept.schema.fields:
        row = row + _value_bytes(f)
    found = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("bigint")).alias("b")).first()
    return kept, found.n, found.b or 0


def broadcast_if_small(df: DataFrame) -> tuple[DataFrame, bool]:
    """``(table, broadcast?)``: the materialized table, wrapped in a broadcast
    hint when its measured size is under the broadcast threshold."""
    kept, _, size = measured(df)
    limit = broadcast_limit_bytes(df)
    small = 0 <= size <= limit
    return (F.broadcast(kept) if small else kept), small
