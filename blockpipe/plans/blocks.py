"""Blocks and linked pipelines (G1, G2, H1).

A block is a plain Python function of keyword arguments that returns a lazy
DataFrame. Linking blocks composes their DataFrames: nothing is computed
until an action, and no data passes through the driver between blocks.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

RESULT_NAME = "result"


class PipelineError(RuntimeError):
    """A pipeline cannot run: a cycle, a missing source, or a failing block."""


def _accepts(fn: Callable, name: str) -> bool:
    try:
        params = inspect.signature(fn).parameters
    except (TypeError, ValueError):
        return False
    return name in params or any(p.kind is inspect.Parameter.VAR_KEYWORD for p in params.values())


def _first(data: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    if isinstance(data, Mapping):
        if not data:
            raise PipelineError("the source block has no dataset")
        return next(iter(data.values()))
    return data


def run_block(fn: Callable[..., Any], df: DataFrame | Mapping[str, DataFrame] | None = None, **args) -> DataFrame:
    """Call a block function.

    ``df`` (the upstream dataset; the first one if there are several)
    overrides any ``df`` argument. A DataFrame result is kept; a Column is
    evaluated against ``df`` as a one-column frame; anything else is a
    ``TypeError`` naming the type.
    """
    if df is not None:
        df = _first(df)
        args = {**args, "df": df}
    result = fn(**args)
    if isinstance(result, DataFrame):
        return result
    if isinstance(result, Column):
        if df is None:
            raise TypeError("a block returned a Column but has no upstream DataFrame")
        return df.select(result)
    name = getattr(fn, "__name__", repr(fn))
    raise TypeError(f"block {name!r} gave a {type(result).__name__}; a block gives a DataFrame or one Column")


class GroupTooLargeError(RuntimeError):
    """A group is too big to hand to one pandas call."""


def pandas_block(
    df: DataFrame,
    fn: Callable,
    schema: str,
    keys: Sequence[str] | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Run pandas code at scale.

    With ``keys``, ``fn(pandas.DataFrame) -> pandas.DataFrame`` runs once per
    group (``applyInPandas``): use it when the code needs whole groups. A
    group is one task's work and one pandas frame in memory, so a hot key
    cannot be split without changing what ``fn`` sees. With ``max_group_rows`` the
    largest group is measured first (one aggregation with map-side combine), and a
    bigger one raises ``GroupTooLargeError`` before any pandas code runs; by
    default any group is passed on. Without keys, ``fn`` maps each
    Arrow batch (``mapInPandas``) and must be row-wise. Whole-frame pandas
    code is not supported: it cannot scale.
    """
    if keys:
        if max_group_rows is not None:
            from blockpipe.plans.ranking import largest_group

            biggest = largest_group(df, keys)
            if biggest > max_group_rows:
                raise GroupTooLargeError(
                    f"a group of {list(keys)} has {biggest} rows (limit {max_group_rows}); "
                    "use finer keys or row-wise code"
                )
        return df.groupBy(*keys).applyInPandas(fn, schema=schema)

    def per_batch(batches: Iterable):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(per_batch, schema=schema)


@dataclass
class Block:
    """One linked block: ``fn`` gets ``args`` plus ``df`` (source output) and
    ``spark`` when it takes them. ``source`` names the upstream block;
    ``section`` and ``section_type`` place it in the pipeline's layout;
    ``snapshot=False`` leaves it out of a pipeline's snapshots (for blocks that only
    read or project, which cost less to repeat than to store). ``reads`` names what
    the block reads beside its source (paths or catalog tables): ``resume_pipeline``
    computes it again when that changes."""

    name: str
    fn: Callable[..., Any]
    source: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    section: str = "main"
    section_type: str = "Transformation"
    snapshot: bool = True
    reads: Sequence[str] = ()


class PipelineOutputs(dict):
    """Outputs by block. ``release()``, or leaving a ``with`` block, frees what the run
    has persisted; the outputs still work, computed from their sources."""

    def __init__(self):
        super().__init__()
        self.persisted: list[DataFrame] = []

    def release(self) -> None:
        while self.persisted:
            self.persisted.pop().unpersist()

    def __enter__(self) -> PipelineOutputs:
        return self

    def __exit__(self, *error) -> None:
        self.release()


def blocks_table(spark: SparkSession, project: str, blocks: Sequence[Block]) -> DataFrame:
    """The blocks of one pipeline as rows of the lineage table read by
    ``block_adjacency``: sections and blocks numbered in list order."""
    from blockpipe.plans.lineage import BLOCKS_DDL

    section_pos: dict[str, int] = {}
    section_of = {b.name: b.section for b in blocks}
    rows = []
    for i, b in enumerate(blocks):
        pos = section_pos.setdefault(b.section, len(section_pos) + 1)
        src_section = section_of.get(b.source) if b.source else None
        rows.append((project, pos, b.section_type, i + 1, b.name, True, True, src_section, b.source))
    return spark.createDataFrame(rows, BLOCKS_DDL)


def topological_order(blocks: Sequence[Block]) -> list[Block]:
    by_name = {}
    for b in blocks:
        if b.name in by_name:
            raise PipelineError(f"two blocks are named {b.name!r}")
        by_name[b.name] = b
    for b in blocks:
        if b.source is not None and b.source not in by_name:
            raise PipelineError(f"block {b.name!r} reads from missing block {b.source!r}")
    done: list[Block] = []
    state: dict[str, int] = {}

    def visit(b: Block, path: list[str]):
        s = state.get(b.name, 0)
        if s == 2:
            return
        if s == 1:
            cycle = path[path.index(b.name):] + [b.name]
            raise PipelineError("cycle between blocks: " + " -> ".join(cycle))
        state[b.name] = 1
        if b.source is not None:
            visit(by_name[b.source], path + [b.name])
        state[b.name] = 2
        done.append(b)

    for b in blocks:
        visit(b, [])
    return done


def run_pipeline(
    spark: SparkSession,
    blocks: Sequence[Block],
    persist_shared: bool = True,
    snapshot_dir: str | None = None,
) -> PipelineOutputs:
    """Run linked blocks in dependency order; each gets its source block's
    output, and one source may feed several blocks. A block whose output
    feeds two or more blocks is persisted (memory and disk), so the shared
    part is computed once; lost cached partitions are rebuilt from lineage. The result's
    ``release()`` frees them.
    A cycle or a missing source fails before anything runs.

    With ``snapshot_dir`` (a shared folder), the datasets of every block (but those
    with ``snapshot=False``) are saved as a snapshot under ``snapshot_dir/<block>`` as soon as the block runs,
    and later blocks read the saved data: each block is computed once and
    its lineage ends at its snapshot. Persisting is then unnecessary."""
    order = topological_order(blocks)
    fanout: dict[str, int] = {}
    for b in blocks:
        if b.source is not None:
            fanout[b.source] = fanout.get(b.source, 0) + 1
    outputs = PipelineOutputs()
    for b in order:
        args = dict(b.args)
        if _accepts(b.fn, "spark"):
            args.setdefault("spark", spark)
        try:
            if b.source is not None:
                result = run_block(b.fn, outputs[b.source], **args)
            else:
                # a first block reads data; it may return several datasets by name
                result = b.fn(**args)
                if not isinstance(result, (DataFrame, Mapping)):
                    raise TypeError(f"block {b.name!r} returned {type(result)}")
        except Exception as exc:
            raise PipelineError(f"block {b.name!r} failed: {exc}") from exc
        if snapshot_dir is not None and b.snapshot:
            from blockpipe.sources.io import read_saved, save_snapshot

            frames = result if isinstance(result, Mapping) else {RESULT_NAME: result}
            paths = save_snapshot(frames, f"{snapshot_dir.rstrip('/')}/{b.name}")
            saved = {k: read_saved(spark, paths[k], frames[k].schema) for k in frames}
            result = saved if isinstance(result, Mapping) else saved[RESULT_NAME]
        elif persist_shared and fanout.get(b.name, 0) >= 2:
            if isinstance(result, Mapping):
                result = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in result.items()}
            else:
                result = result.persist(StorageLevel.MEMORY_AND_DISK)
            outputs.persisted += list(result.values()) if isinstance(result, Mapping) else [result]
        outputs[b.name] = result
    return outputs
