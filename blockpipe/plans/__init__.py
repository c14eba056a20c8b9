"""Composite plans: SQL models (F), blocks and pipelines (G, H1), block
lineage (H2), and the skew-safe ranking they and the operators share."""

from blockpipe.plans.blocks import (
    Block,
    GroupTooLargeError,
    PipelineError,
    PipelineOutputs,
    blocks_table,
    pandas_block,
    run_block,
    run_pipeline,
)
from blockpipe.plans.lineage import BLOCKS_DDL, block_adjacency
from blockpipe.plans.model import ModelError, ensure_database, read_model, run_model
from blockpipe.plans.resume import PipelineRun, resume_pipeline
from blockpipe.plans.ranking import group_mode, group_modes, null_safe_join, quantiles, rank_within

__all__ = [
    "BLOCKS_DDL",
    "Block",
    "GroupTooLargeError",
    "ModelError",
    "PipelineError",
    "PipelineOutputs",
    "PipelineRun",
    "block_adjacency",
    "ensure_database",
    "blocks_table",
    "group_mode",
    "group_modes",
    "null_safe_join",
    "pandas_block",
    "quantiles",
    "rank_within",
    "read_model",
    "resume_pipeline",
    "run_block",
    "run_model",
    "run_pipeline",
]
