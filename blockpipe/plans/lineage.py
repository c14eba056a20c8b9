"""Dependency lists over a table of blocks, many pipelines at once (H2).

Input columns: ``project, section_pos, section_type, block_pos, block,
has_setup, has_code, source_section, source_block``. Rules:

* blocks of an orchestration section are skipped;
* a block counts only when it has both setup and code;
* an edge needs both source ids (non-empty);
* the source itself is not checked, so a deleted source still gets a key;
* every counted block gets a key, with an empty list when nothing reads it;
* a list is in section order, then block order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORCHESTRATION = "orchestration"

BLOCKS_DDL = (
    "project string, section_pos int, section_type string, block_pos int, block string, "
    "has_setup boolean, has_code boolean, source_section string, source_block string"
)


def block_adjacency(blocks: DataFrame) -> DataFrame:
    """``(project, block, adj array<string>)``: for each block, the blocks
    that read from it. Two aggregations and one join; no driver loop."""
    nodes = blocks.where(
        (F.lower(F.col("section_type")) != ORCHESTRATION)
        & F.coalesce(F.col("has_setup"), F.lit(False))
        & F.coalesce(F.col("has_code"), F.lit(False))
    )
    has_src = (
        F.col("source_section").isNotNull()
        & (F.col("source_section") != "")
        & F.col("source_block").isNotNull()
        & (F.col("source_block") != "")
    )
    edges = nodes.where(has_src).select(
        "project",
        F.col("source_block").alias("block"),
        F.struct("section_pos", "block_pos", F.col("block").alias("child")).alias("_bp_e"),
    )
    lists = edges.groupBy("project", "block").agg(
        F.transform(F.sort_array(F.collect_list("_bp_e")), lambda e: e["child"]).alias("adj")
    )
    keys = nodes.select("project", "block").unionByName(edges.select("project", "block")).distinct()
    out = keys.join(lists, on=["project", "block"], how="left")
    return out.select("project", "block", F.coalesce("adj", F.array().cast("array<string>")).alias("adj"))
