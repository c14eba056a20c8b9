"""Re-running linked blocks from saved outputs (H1).

Every block has a fingerprint: its code, its arguments, the version of what it reads
and its source's fingerprint. A snapshot saved under a fingerprint is what the
block would give now, so it is read instead of computing the block and all above it.
A changed argument changes the fingerprints of that block and of those below, and
of no others.
"""

from __future__ import annotations

import functools
import hashlib
import types
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockpipe.plans.blocks import RESULT_NAME, Block, PipelineError, _accepts, run_block, topological_order
from blockpipe.sources.io import read_saved, save_snapshot, saved_under


def _described(value: Any, seen: frozenset = frozenset()) -> str:
    """A text that is equal for equal values, also in another process. An object
    that only its address describes is never equal, so its block is computed anew."""
    if isinstance(value, Mapping):
        return "{" + ",".join(sorted(f"{_described(k, seen)}:{_described(v, seen)}" for k, v in value.items())) + "}"
    if isinstance(value, (set, frozenset)):
        return "s(" + ",".join(sorted(_described(v, seen) for v in value)) + ")"
    if isinstance(value, (list, tuple)):
        return f"{type(value).__name__}(" + ",".join(_described(v, seen) for v in value) + ")"
    if isinstance(value, functools.partial):
        return "partial" + _described((value.func, value.args, value.keywords), seen)
    if isinstance(value, types.MethodType):
        return "method" + _described((value.__func__, value.__self__), seen)
    if isinstance(value, types.FunctionType):
        return _code(value, seen)
    if isinstance(value, types.CodeType):
        consts = [_described(c, seen) for c in value.co_consts]
        return f"code({value.co_code.hex()},{value.co_names},{value.co_varnames},{consts})"
    if isinstance(value, types.ModuleType):
        return f"module {value.__name__}"
    if isinstance(value, Column):
        return f"column {value}"
    if isinstance(value, DataFrame):
        return f"frame {value.schema.json()} {value.semanticHash()} {_files_version(value.sparkSession, value.inputFiles())}"
    return f"{type(value).__module__}.{type(value).__qualname__} {value!r}"


def _code(fn: types.FunctionType, seen: frozenset) -> str:
    """A function by its byte code, defaults, closure, and the functions and plain
    values of its own module that it names."""
    if fn in seen:
        return f"again {fn.__qualname__}"
    seen = seen | {fn}
    names = set()

    def collect(code: types.CodeType) -> None:
        names.update(code.co_names)
        for c in code.co_consts:
            if isinstance(c, types.CodeType):
                collect(c)

    collect(fn.__code__)
    used = {}
    for name in sorted(names & set(fn.__globals__)):
        value = fn.__globals__[name]
        own = isinstance(value, types.FunctionType) and value.__module__ == fn.__module__
        if own or isinstance(value, (str, int, float, bool, tuple, frozenset)):
            used[name] = value
    cells = dict(zip(fn.__code__.co_freevars, (c.cell_contents for c in fn.__closure__ or ())))
    cells = {k: v for k, v in cells.items() if not isinstance(v, SparkSession)}
    parts = (fn.__code__, fn.__defaults__, fn.__kwdefaults__, cells, used)
    return f"function {fn.__qualname__}" + _described(parts, seen)


def _files_version(spark: SparkSession, files: Sequence[str]) -> str:
    """Number, bytes and a hash of paths, sizes and times of files; their contents
    are not read."""
    if not files:
        return "no files"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(files))
    mark = F.xxhash64("path", "length", "modificationTime")
    return str(tuple(listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(mark)).first()))


def _reads_version(spark: SparkSession, name: str) -> str:
    if "/" in name:
        return _files_version(spark, [name])
    return _files_version(spark, spark.table(name).inputFiles())


@dataclass
class PipelineRun:
    """What a run gave: the outputs asked for, and which blocks were computed and
    which read from snapshots; blocks in neither were not needed."""

    outputs: dict[str, DataFrame | dict[str, DataFrame]]
    computed: list[str]
    reused: list[str]


def resume_pipeline(
    spark: SparkSession,
    blocks: Sequence[Block],
    snapshot_dir: str,
    only: str | Sequence[str] | None = None,
    force: Sequence[str] = (),
) -> PipelineRun:
    """Run the blocks named by ``only`` (default: those that feed no other), reading
    every valid snapshot below ``snapshot_dir`` and computing what has none; blocks
    computed are saved (but those with ``snapshot=False``). Of a block that is read
    from its snapshot, nothing above is read or computed. ``force`` names blocks to
    compute in any case; those below are computed again too.

    A first block (no source) is called to see which files it would read: their names,
    sizes and times are its version, so changed data are noticed. What another block
    reads beside its source must be named in ``Block.reads`` (paths or catalog
    tables). A first block that reads no files (JDBC, generated rows) has only
    its ``version`` argument or code to tell that its data changed. Functions of
    other modules that a block calls are taken as unchanged.
    """
    order = topological_order(blocks)
    by_name = {b.name: b for b in order}
    feeds = {b.source for b in order}
    wanted = [only] if isinstance(only, str) else list(only or [b.name for b in order if b.name not in feeds])
    for name in [*wanted, *force]:
        if name not in by_name:
            raise PipelineError(f"there is no block {name!r}")

    needed: set[str] = set()
    for name in wanted:
        while name is not None and name not in needed:
            needed.add(name)
            name = by_name[name].source
    marks: dict[str, str] = {}
    first: dict[str, DataFrame | Mapping[str, DataFrame]] = {}
    again: set[str] = set()
    for b in order:
        if b.name not in needed:
            continue
        seen = [_described(b.fn), _described(b.args), b.source or ""]
        seen += [f"{r} {_reads_version(spark, r)}" for r in b.reads]
        if b.source is None:
            first[b.name] = _called(spark, b, None)
            frames = first[b.name] if isinstance(first[b.name], Mapping) else {RESULT_NAME: first[b.name]}
            for key, df in frames.items():
                seen += [key, df.schema.json(), _files_version(spark, df.inputFiles())]
        else:
            seen.append(marks[b.source])
        marks[b.name] = hashlib.sha256("\n".join(seen).encode()).hexdigest()
        if b.name in force or b.source in again:
            again.add(b.name)

    run = PipelineRun({}, [], [])
    done: dict[str, DataFrame | dict[str, DataFrame]] = {}

    def output(name: str):
        if name in done:
            return done[name]
        b = by_name[name]
        folder = f"{snapshot_dir.rstrip('/')}/{b.name}"
        if b.snapshot and name not in again:
            frames = saved_under(spark, folder, marks[name])
            if frames is not None:
                run.reused.append(name)
                done[name] = frames[RESULT_NAME] if set(frames) == {RESULT_NAME} else frames
                return done[name]
        result = first[name] if b.source is None else _called(spark, b, output(b.source))
        if b.snapshot:
            frames = result if isinstance(result, Mapping) else {RESULT_NAME: result}
            paths = save_snapshot(frames, folder, marks[name])
            saved = {k: read_saved(spark, paths[k], frames[k].schema) for k in frames}
            result = saved if isinstance(result, Mapping) else saved[RESULT_NAME]
        run.computed.append(name)
        done[name] = result
        return result

    for name in wanted:
        run.outputs[name] = output(name)
    return run


def _called(spark: SparkSession, block: Block, source):
    args = dict(block.args)
    if _accepts(block.fn, "spark"):
        args.setdefault("spark", spark)
    try:
        if block.source is not None:
            return run_block(block.fn, source, **args)
        result = block.fn(**args)
        if not isinstance(result, (DataFrame, Mapping)):
            raise TypeError(f"block {block.name!r} returned {type(result)}")
        return result
    except Exception as exc:
        raise PipelineError(f"block {block.name!r} failed: {exc}") from exc
