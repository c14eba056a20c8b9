"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has a link to another one; the component
    is its smallest id. ``edges`` has two columns of long ids; nulls, loops and
    repeated links are ignored.

    Each round links every node's larger neighbours to its smallest one, then its
    smaller ones likewise (the "large star" and "small star" of Kiveris and others,
    2014). Both are a grouped minimum, with partial minima before the shuffle, and a
    join that can be split at a hub, so no node's neighbours are ever gathered.
    Rounds grow with the logarithm of the number of ids; each is written to the
    shared folder.
    """
    a, b = F.col(a), F.col(b)
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    current = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
        current = written(small.distinct(), "links")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
