"""CSV files with line breaks in quotes, read by many tasks (A4, A5, A9).

Spark splits a CSV file only if no quoted value holds a line break. Here the file is
read as lines, which can be split anywhere, in two passes. The first notes for each
chunk of a file whether its end lies inside quotes, once for a chunk that begins outside
and once for one that begins inside; running these along the chunks gives every
chunk's true beginning. The second puts the lines of each record together, chunk by
chunk, starting from there. A record cut by a chunk's end is joined from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from blockpipe.functions import quoted
from blockpipe.plans.sizing import broadcast_if_small

WHOLE, HEAD, TAIL = range(3)  # a record; a record's last or middle piece; its first piece
_CHUNK = ["file", "start"]
# the narrowest type that all values have is taken, in this order
INFERRED = ("int", "bigint", "double", "date", "timestamp", "boolean")


def inside_after(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether the end of ``line`` lies inside quotes, if its beginning does or does
    not. A quote opens a value only at its beginning; doubled, it is a quote."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(sep, at) + len(sep)
                if at < len(sep):
                    return False
                continue
            at += len(quote)
        close = line.find(quote, at)
        while close >= 0 and line.startswith(quote, close + len(quote)):
            close = line.find(quote, close + 2 * len(quote))
        if close < 0:
            return True
        inside = False
        at = line.find(sep, close) + len(sep)  # what follows a closing quote is text up to there
        if at < len(sep):
            return False


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array, list[int]]]:
    """(chunk, lines, which lines have a quote) for each run of lines of a chunk."""
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    change = [i + 1 for i in (codes[1:] != codes[:-1]).nonzero()[0].tolist()]
    change = sorted(set(change) | {i + 1 for i in (starts[1:] != starts[:-1]).nonzero()[0].tolist()})
    for lo, hi in zip([0, *change], [*change, batch.num_rows]):
        chunk = files.dictionary[int(codes[lo])].as_py(), int(starts[lo])
        yield chunk, batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo).to_numpy(False).nonzero()[0].tolist()


def _ends(sep: str, quote: str):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, done = None, (False, True), []
        for batch in batches:
            for chunk, lines, marked in _slices(batch) if batch.num_rows else ():
                if chunk != current:
                    if current:
                        done.append((*current, *states))
                    current, states = chunk, (False, True)
                for i in marked:  # a line without a quote changes nothing
                    line = lines[i].as_py()
                    states = tuple(inside_after(line, s, sep, quote) for s in states)
            columns = list(zip(*done)) if done else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            names = [*_CHUNK, "out", "in"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            done = []
        if current:
            arrays = [[current[0]], [current[1]], [states[0]], [states[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[*_CHUNK, "out", "in"])

    return ends


def _records(sep: str, quote: str, begin_inside: frozenset, header: bool):
    """Lines to (file, start, kind, text): whole records, and the pieces of records
    that a chunk's ends cut; without each file's first record if that is a header."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, inside, headless, skip = None, [], False, False, False

        def piece(kind, chunk, text):
            arrays = [[chunk[0]], [chunk[1]], pa.array([kind], pa.int32()), [text]]
            return pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=[*_CHUNK, "kind", "text"]
            )

        def finished():
            """What is left of a chunk: an open record."""
            if current and held:
                yield piece(HEAD if headless else TAIL, current, "\n".join(held))

        for batch in batches:
            for chunk, lines, marked in _slices(batch) if batch.num_rows else ():
                if chunk != current:
                    yield from finished()
                    current, held = chunk, []
                    inside = headless = chunk in begin_inside
                    skip = header and chunk[1] == 0
                whole, at = [], 0
                for i in [*marked, len(lines)]:
                    if inside:
                        held += lines.slice(at, i - at).to_pylist()
                    elif i > at:
                        whole.append(lines.slice(at, i - at))
                    at = i
                    if i == len(lines):
                        break
                    line = lines[i].as_py()
                    after = inside_after(line, inside, sep, quote)
                    if not inside and not after:
                        whole.append(lines.slice(i, 1))
                    else:
                        held.append(line)
                        if not after:
                            text, held = "\n".join(held), []
                            if headless:
                                yield piece(HEAD, chunk, text)
                            else:
                                whole.append(pa.array([text], lines.type))
                            headless = False
                    inside, at = after, i + 1
                if whole:
                    text = pa.concat_arrays(whole)
                    text, skip = text.slice(int(skip)), False
                    n = len(text)
                    columns = [pa.repeat(chunk[0], n), pa.repeat(chunk[1], n), pa.repeat(pa.scalar(WHOLE, pa.int32()), n), text]
                    yield pa.RecordBatch.from_arrays(columns, names=[*_CHUNK, "kind", "text"])
        yield from finished()

    return records


def _beginnings(ends: DataFrame) -> DataFrame:
    """(file, start, inside, open) of each chunk: whether its beginning and its end lie
    inside quotes. A chunk maps both beginnings to one end, or keeps or turns them;
    since the last of the first kind only the turns count."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("out") & ~F.col("in"), 1).otherwise(0)).over(before), F.lit(0))
    fixed = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").cast("int").alias("value"), "turns"))
    counted = ends.withColumn("turns", turns)
    last = F.last(fixed, ignorenulls=True).over(before)
    state = (
        F.coalesce(last["value"], F.lit(0)) + F.col("turns") - F.coalesce(last["turns"], F.lit(0))
    ) % 2 == 1
    found = counted.select(*_CHUNK, "out", "in", state.alias("inside"))
    return found.withColumn("open", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))


def csv_records(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"', header: bool = False
) -> DataFrame:
    """(file, start, text): the records of CSV files, line breaks in quotes kept, each
    with the chunk of the file it begins in; a record's text has no line end of its own.
    With ``header``, without every file's first record.

    Chunks are Spark's file splits, so a large file is read by many tasks. Only what
    is needed of chunks reaches the driver: the names of those that begin inside
    quotes. There is at most one for each ``spark.sql.files.maxPartitionBytes`` of
    input. A task holds one record at a time besides its batch of lines."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
        F.contains("value", F.lit(quote)).alias("marked"),
    )
    schema = "file string, start long, out boolean, in boolean"
    ends, _ = broadcast_if_small(lines.mapInArrow(_ends(sep, quote), schema))
    chunks = _beginnings(ends)
    cut = chunks.where(F.col("inside") | F.col("open"))
    begin_inside = frozenset((r.file, r.start) for r in cut.where("inside").select(*_CHUNK).collect())
    pieces = "file string, start long, kind int, text string"
    whole = lines.mapInArrow(_records(sep, quote, begin_inside, header), pieces).where(F.col("kind") == WHOLE)
    out = whole.select("file", "start", "text")
    if begin_inside:
        edges = lines.join(F.broadcast(cut.select(*_CHUNK)), _CHUNK, "left_semi")
        edges = edges.mapInArrow(_records(sep, quote, begin_inside, header), pieces).where(F.col("kind") != WHOLE)
        # a first piece begins a record, the pieces up to the next first one belong to it
        order = Window.partitionBy("file").orderBy("start", "kind")
        numbered = edges.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
        parts = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
        joined = numbered.groupBy("file", "record").agg(parts.alias("parts"))
        out = out.unionAll(
            joined.select("file", F.col("parts")[0]["start"].alias("start"), F.array_join(F.col("parts.text"), "\n"))
        )
    return out.select("file", "start", F.regexp_replace("text", r"\r\z", "").alias("text"))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns in the narrowest type that all their values have (one pass)."""
    checks = []
    for k, name in enumerate(df.columns):
        value = F.trim(quoted(name))
        for kind in INFERRED:
            fits = value.try_cast(kind).isNotNull()
            if kind == "date":  # a date followed by a time of day is none
                fits = fits & (F.length(value) <= 10)
            ok = F.when(value != "", fits)
            checks.append(F.bool_and(ok).alias(f"{k}_{kind}"))
    found = df.agg(*checks).first()
    out = []
    for k, name in enumerate(df.columns):
        kind = next((t for t in INFERRED if found[f"{k}_{t}"]), None)
        c: Column = quoted(name)
        out.append((F.trim(c).try_cast(kind) if kind else c).alias(name))
    return df.select(*out)


def read_csv_records(
    spark: SparkSession,
    path: str | Sequence[str],
    header: bool = True,
    schema: StructType | str | None = None,
    sep: str = ",",
    quote: str = '"',
    **opts,
) -> DataFrame:
    """CSV by RFC 4180, as a DataFrame: quotes doubled inside quoted values, which may
    hold separators and line breaks; blanks kept; an empty value null and a quoted empty
    one not; files of any size split over tasks; empty lines skipped. Without a schema, columns are named by the first file's
    header (else ``_c0``, ``_c1``, ...) and typed in one further pass."""
    # a null marker that never occurs: an empty value is null, a quoted empty one is not
    spark_opts = {"sep": sep, "quote": quote, "escape": quote, "nullValue": "\u0000", "emptyValue": ""}
    spark_opts |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    spark_opts |= {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in opts.items()}
    named = spark.read.options(**spark_opts).option("header", header).option("multiLine", True)
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    columns = schema or StructType([StructField(c, StringType()) for c in named.csv(path).columns])
    ddl = ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in columns.fields)
    records = csv_records(spark, path, sep, quote, header).where(F.length("text") > 0)
    parsed = records.select(F.from_csv("text", ddl, spark_opts).alias("r")).select("r.*")
    return parsed if schema else _typed(parsed)
