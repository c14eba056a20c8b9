"""Reading, writing and moving data (A1-A10).

Reads are lazy: a table or file is scanned only by the action that needs it,
with the filters and columns Catalyst pushes into the scan. Credentials for
object stores belong in the Hadoop configuration, never in arguments.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    CharType,
    DateType,
    MapType,
    StringType,
    StructField,
    StructType,
    VarcharType,
)

from blockpipe.functions import quoted
from blockpipe.functions.columns import TEXT_TIME_OPTS
from blockpipe.sources.csv import read_csv_records

try:  # TIME arrived in Spark 4.1
    from pyspark.sql.types import TimeType
except ImportError:  # pragma: no cover
    TimeType = None

log = logging.getLogger(__name__)

FILE_FORMATS = ("parquet", "csv", "json", "orc", "text")


def read_table(spark: SparkSession, name: str | None, fmt: str | None = None, **opts) -> DataFrame:
    """One table: a catalog name (``fmt=None``), or a path / table id in
    format ``fmt``; sources addressed by options only (JDBC) take no name."""
    if fmt is None:
        return spark.table(name)
    reader = spark.read.format(fmt).options(**opts)
    return reader.load(name) if name else reader.load()


def dataset_key(name: str) -> str:
    """Dict key of a read dataset: the last dotted part of a table name, or a
    file's name without extension."""
    tail = name.rstrip("/").rsplit("/", 1)[-1]
    if "/" in name:
        return tail.split(".", 1)[0]
    return tail.rsplit(".", 1)[-1]


def read_tables(
    spark: SparkSession,
    names: Sequence[str],
    fmt: str | None = None,
    on_collision: str = "error",
    **opts,
) -> dict[str, DataFrame]:
    """Several tables into ``{key: DataFrame}``. A table that fails to resolve
    is logged and skipped. Two names with the same key fail, unless
    ``on_collision="last"`` (the later one wins)."""
    out: dict[str, DataFrame] = {}
    for name in names:
        try:
            df = read_table(spark, name, fmt, **opts)
            df.schema  # resolve now, inside the try
        except PySparkException as exc:
            log.error("read_tables: skipping %s: %s", name, exc)
            continue
        key = dataset_key(name)
        if key in out and on_collision != "last":
            raise ValueError(f"two tables map to the dataset name {key!r}")
        out[key] = df
    return out


def normalize_dates(df: DataFrame) -> DataFrame:
    """Date columns become ``timestamp_ntz`` and time-of-day columns become a
    day-time interval (time since midnight), so every snapshot format keeps them."""
    changed = {}
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, DateType):
            changed[f.name] = c.cast("timestamp_ntz")
        elif TimeType is not None and isinstance(f.dataType, TimeType):
            # TIME supports little more than a cast to text here: HH:mm:ss[.ffffff]
            parts = F.split(c.cast("string"), ":")
            changed[f.name] = F.make_dt_interval(
                F.lit(0),
                F.get(parts, 0).cast("int"),
                F.get(parts, 1).cast("int"),
                F.get(parts, 2).cast("decimal(8,6)"),
            )
    return df.withColumns(changed) if changed else df


# Options that reading by records takes; with others Spark's own reader is used.
_RECORD_OPTS = {
    "sep", "quote", "nullValue", "emptyValue", "nanValue", "positiveInf", "negativeInf", "dateFormat",
    "timestampFormat", "timestampNTZFormat", "locale", "mode", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace",
}


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    header: bool = True,
    schema: StructType | str | None = None,
    **opts,
) -> DataFrame:
    """CSV (UTF-8, RFC 4180) from any Hadoop file system path: quotes are doubled inside
    quoted values, which may hold separators and line breaks; blanks are kept; an
    empty value is null, a quoted empty one is an empty text. A file of any size is read by many tasks, also with line
    breaks in quotes (``sources.csv``). Without a schema, types are inferred (one
    extra pass); give one for large inputs.

    With options beyond those of ``_RECORD_OPTS`` (another ``escape``, ``encoding``,
    ``multiLine``, ...) Spark's own reader is used with just these."""
    if opts.get("escape") == opts.get("quote", '"'):
        opts.pop("escape")
    if set(opts) <= _RECORD_OPTS and not _in_folders(spark, path):
        return read_csv_records(spark, path, header, schema, **opts)
    reader = spark.read.option("header", header).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def _in_folders(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether folders named ``column=value`` hold some of the columns."""
    return spark.read.text(path).columns != ["value"]


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **opts) -> DataFrame:
    """Files in ``fmt`` from a path or object store URI (``s3a://``, ...)."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"fmt must be one of {FILE_FORMATS}, got {fmt!r}")
    if fmt == "csv":
        return read_csv(spark, path, schema=schema, **opts)
    reader = spark.read.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


# CSV as written here: RFC 4180 quoting (inner quotes doubled), null as an
# empty field, an empty string as "", blanks at the ends kept. Reading it back
# with a null marker that never occurs keeps the two apart (Spark's default reads
# both as null). Only one-column files differ: there a null would be an empty
# line, which readers skip, so it is written as the marker itself.
_NULL_MARK = "\u0000"
_CSV_OPTS = {
    "header": "true",
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _has_text(schema: StructType) -> bool:
    return any(isinstance(f.dataType, (StringType, CharType, VarcharType)) for f in schema.fields)


def _csv_write_opts(schema: StructType) -> dict[str, str]:
    return {**_CSV_OPTS, "nullValue": _NULL_MARK if len(schema.fields) == 1 else "", "emptyValue": '""'}


def _csv_read_opts(schema: StructType) -> dict[str, str]:
    """Values of other than text hold no line breaks; such files stay splittable
    (but for one column, where line by line reading skips the marker)."""
    whole = _has_text(schema) or len(schema.fields) == 1
    return {**_CSV_OPTS, "nullValue": _NULL_MARK, "emptyValue": "", "multiLine": str(whole).lower()}


_NESTED = (ArrayType, MapType, StructType)


def _as_csv(df: DataFrame) -> DataFrame:
    """Columns that CSV has no form for as text: binary in base 64, nested ones as JSON."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, BinaryType):
            changed[f.name] = F.base64(quoted(f.name))
        elif isinstance(f.dataType, _NESTED):
            changed[f.name] = F.to_json(quoted(f.name), {**TEXT_TIME_OPTS, "ignoreNullFields": "false"})
    return df.withColumns(changed) if changed else df


def _from_csv(df: DataFrame, schema: StructType) -> DataFrame:
    out = []
    for f in schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, BinaryType):
            c = F.unbase64(c)
        elif isinstance(f.dataType, _NESTED):
            c = F.from_json(c, f.dataType, TEXT_TIME_OPTS)
        out.append(c.alias(f.name))
    return df.select(*out)


def _read_csv_back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    odd = (BinaryType, *_NESTED)
    stored = StructType(
        [StructField(f.name, StringType() if isinstance(f.dataType, odd) else f.dataType) for f in schema.fields]
    )
    if _has_text(stored) and not _in_folders(spark, path):  # line breaks in quotes, split all the same
        df = read_csv_records(spark, path, schema=stored, **TEXT_TIME_OPTS)
    else:
        df = spark.read.options(**TEXT_TIME_OPTS, **_csv_read_opts(stored)).schema(stored).csv(path)
    return _from_csv(df, schema)


def _read_back(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """Read what was just written, with its schema and column order (a
    partitioned write moves partition columns to the end)."""
    if fmt == "csv":
        df = _read_csv_back(spark, path, schema)
    elif fmt == "json":
        df = spark.read.options(**TEXT_TIME_OPTS).schema(schema).json(path)
    else:
        df = read_files(spark, path, fmt, schema=schema)
    return df.select(*[quoted(n) for n in schema.fieldNames()])


def _writer(df: DataFrame, fmt: str, mode: str, partition_by: Sequence[str] | None, **opts):
    df = _as_csv(df) if fmt == "csv" else df
    w = df.write.format(fmt).mode(mode)
    if fmt in ("csv", "json"):
        w = w.options(**TEXT_TIME_OPTS)
    if fmt == "csv":
        w = w.options(**_csv_write_opts(df.schema))
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.options(**opts)


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    fmt: str | None = None,
    bucket_by: tuple[int, Sequence[str]] | None = None,
    sort_by: Sequence[str] | None = None,
) -> str:
    """Write to catalog table ``name`` (a rerun replaces it by default).

    ``bucket_by=(n, keys)`` stores the rows hashed into ``n`` buckets by
    ``keys`` (and ``sort_by`` within each bucket): later joins and
    aggregations of two tables bucketed the same way on those keys read
    co-located buckets and skip the shuffle.
    """
    w = df.write.mode(mode)
    if fmt:
        w = w.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, keys = bucket_by
        keys = [keys] if isinstance(keys, str) else list(keys)
        w = w.bucketBy(n, keys[0], *keys[1:])
        if sort_by:
            w = w.sortBy(sort_by[0], *sort_by[1:])
    w.saveAsTable(name)
    return name


def write_files(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    **opts,
) -> str:
    _writer(df, fmt, mode, partition_by, **opts).save(path)
    return path


def move(
    spark: SparkSession,
    source: DataFrame | str,
    destination: str,
    mode: str = "overwrite",
    source_fmt: str | None = None,
    destination_fmt: str | None = None,
    partition_by: Sequence[str] | None = None,
    bucket_by: tuple[int, Sequence[str]] | None = None,
    **read_opts,
) -> DataFrame:
    """Copy ``source`` (a DataFrame, a catalog table, or files when
    ``source_fmt`` is given) to ``destination`` (a catalog table, or files
    when ``destination_fmt`` is given). Returns the destination, read back
    lazily. Overwrites on rerun unless ``mode`` says otherwise. A table
    destination can be bucketed (see ``write_table``)."""
    df = source if isinstance(source, DataFrame) else read_table(spark, source, source_fmt, **read_opts)
    if destination_fmt is None:
        write_table(df, destination, mode, partition_by, bucket_by=bucket_by)
        return spark.table(destination)
    write_files(df, destination, destination_fmt, mode, partition_by)
    return _read_back(spark, destination, destination_fmt, df.schema)


def convert_files(
    spark: SparkSession,
    src: str,
    src_fmt: str,
    dst: str,
    dst_fmt: str,
    partition_by: Sequence[str] | None = None,
    schema=None,
    mode: str = "overwrite",
    **read_opts,
) -> DataFrame:
    """Convert stored files from one format to another in one distributed
    pass; returns the converted files, read back with the source schema."""
    df = read_files(spark, src, src_fmt, schema=schema, **read_opts)
    write_files(df, dst, dst_fmt, mode, partition_by)
    return _read_back(spark, dst, dst_fmt, df.schema)


def export_csv(df: DataFrame, path: str, n: int | None = None, mode: str = "overwrite") -> str:
    """CSV for download: header, values quoted where needed, inner quotes
    doubled, null as an empty field, empty text as ``""``, binary in base 64, nested values as
    JSON. ``n`` keeps the
    first rows only (a preview)."""
    out = df.limit(n) if n is not None else df
    # no quoteAll: Spark would quote nulls too, making them "" like empty text
    out = _as_csv(out)
    out.write.mode(mode).options(**TEXT_TIME_OPTS, **_csv_write_opts(df.schema)).csv(path)
    return path


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a CSV written by ``export_csv`` or ``write_files`` back exactly."""
    return _read_back(spark, path, "csv", schema)


# --- A8: block snapshots ---------------------------------------------------------------

_MANIFEST = "manifest"
_MANIFEST_DDL = "version bigint, dataset string, path string, schema string, fingerprint string"


def save_snapshot(
    dfs: Mapping[str, DataFrame] | DataFrame, directory: str, fingerprint: str | None = None
) -> dict[str, str]:
    """Persist all datasets of a block under ``directory``; returns
    ``{dataset: path}`` of what was written. ``saved_under`` finds the snapshot by
    its ``fingerprint``.

    Each save writes a new version folder, then appends one manifest file
    naming the version's datasets and their schemas. Readers follow the
    newest manifest entry, so a save that dies halfway leaves the previous
    snapshot in force, and a save replaces all earlier datasets of the block: a
    save of no dataset at all leaves an empty snapshot.
    """
    if isinstance(dfs, DataFrame):
        dfs = {"result": dfs}
    version = time.time_ns()  # newer saves sort later
    base = directory.rstrip("/")
    folder = f"{base}/v{version}-{uuid.uuid4().hex[:8]}"
    rows = []
    spark = SparkSession.active()
    for name, df in dfs.items():
        path = f"{folder}/{name}"
        df.write.mode("error").parquet(path)
        rows.append((int(version), name, path, df.schema.json(), fingerprint))
    if not rows:
        spark.createDataFrame([(int(version), None, None, None, fingerprint)], _MANIFEST_DDL).coalesce(1).write.mode(
            "append"
        ).parquet(f"{base}/{_MANIFEST}")
        return {}
    manifest = spark.createDataFrame(rows, _MANIFEST_DDL)
    manifest.coalesce(1).write.mode("append").parquet(f"{base}/{_MANIFEST}")
    return {r[1]: r[2] for r in rows}


def read_saved(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A saved dataset, read with its known schema (no footer inference)."""
    if isinstance(schema, str):
        schema = StructType.fromJson(json.loads(schema))
    return spark.read.schema(schema).parquet(path)


def _manifest(spark: SparkSession, directory: str) -> DataFrame | None:
    try:
        found = spark.read.schema(_MANIFEST_DDL).parquet(f"{directory.rstrip('/')}/{_MANIFEST}")
        return found if found.inputFiles() else None
    except PySparkException:
        return None


def _datasets(spark: SparkSession, manifest: DataFrame) -> dict[str, DataFrame] | None:
    newest = manifest.agg(F.max("version")).first()[0]
    if newest is None:
        return None
    rows = manifest.where((F.col("version") == newest) & F.col("dataset").isNotNull()).collect()
    return {r.dataset: read_saved(spark, r.path, r.schema) for r in sorted(rows, key=lambda r: r.dataset)}


def load_snapshot(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The datasets of the newest complete snapshot; ``{}`` when there is none.
    Two small jobs read the manifest."""
    manifest = _manifest(spark, directory)
    return (_datasets(spark, manifest) if manifest is not None else None) or {}


def saved_under(spark: SparkSession, directory: str, fingerprint: str) -> dict[str, DataFrame] | None:
    """The datasets of the newest complete snapshot with this fingerprint, or None."""
    manifest = _manifest(spark, directory)
    return _datasets(spark, manifest.where(F.col("fingerprint") == fingerprint)) if manifest is not None else None
