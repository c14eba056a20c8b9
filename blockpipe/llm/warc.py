"""WARC archives as a Spark data source, with payload deduplication on writing.

Writing: every task writes gzip members, one for each record, into files of bounded
size; a record whose payload an earlier one has is a ``revisit`` without payload.
Each member names its own length (the ``sl`` field of the WARC specification's
gzip annex). Reading: files are planned into partitions by size; record-type and
header predicates are pushed down; a record's headers are parsed first, and a record
that they rule out is skipped by its length, its payload never decoded.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

FORMAT = "warc_archive"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length long, content_type string, headers map<string, string>, payload binary"
)
# column -> header it is taken from; predicates on these columns are pushed down
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
}
MIN_REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _files(path: str):
    """The file system of ``path`` and the path on it; any that pyarrow can reach."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


# --- records -------------------------------------------------------------------------------


def member(raw: bytes, level: int = 6) -> bytes:
    """``raw`` as one gzip member that says how long it is, packed and unpacked."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; header values lose their line ends, null ones are left out."""
    lines = ["WARC/1.1"]
    for name, value in fields:
        if value is not None:
            lines.append(f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _payload(block: bytes, headers: dict[str, str]) -> bytes:
    """The block without its HTTP headers, if it has them."""
    if headers.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else block
    return block


def records(file, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the wanted records of an open archive, packed record
    by record or not packed at all."""
    while True:
        start = file.tell()
        head = file.read(24)
        if not head:
            return
        if head[:2] == b"\x1f\x8b":
            size = 0
            if len(head) == 24 and head[3] == 4 and head[12:16] == b"sl\x08\0":
                size = struct.unpack("<I", head[16:20])[0]
            yield from _packed(file, start, size, wanted, with_payload)
        elif head[:5] == b"WARC/":
            file.seek(start)
            yield from _plain(file, wanted, with_payload)
        else:
            raise ValueError(f"no WARC record at byte {start}")


def _packed(file, start: int, size: int, wanted, with_payload: bool):
    file.seek(start)
    inflate, text, at = zlib.decompressobj(31), b"", -1
    while at < 0:  # unpack only as far as the headers go
        chunk = inflate.unconsumed_tail or file.read(min(size, 4096) if size else 4096)
        if not chunk:
            raise ValueError(f"a WARC record at byte {start} is cut off")
        text += inflate.decompress(chunk, 4096)
        at = text.find(b"\r\n\r\n")
    headers = parse_headers(text[:at])
    take = wanted(headers)
    if not size or (take and with_payload):
        length = int(headers.get("content-length", "0"))
        parts, have = [text[at + 4 :]], len(text) - at - 4
        while not inflate.eof:
            chunk = inflate.unconsumed_tail or file.read(1 << 16)
            if not chunk:
                break
            part = inflate.decompress(chunk, 1 << 20)
            if take and with_payload:
                parts.append(part)
            have += len(part)
        if have < length:
            raise ValueError(f"a WARC record at byte {start} is cut off")
        file.seek(start + size if size else file.tell() - len(inflate.unused_data))
        if take:
            yield headers, _payload(b"".join(parts)[:length], headers) if with_payload else None
    else:
        file.seek(start + size)
        if take:
            yield headers, None


def _plain(file, wanted, with_payload: bool):
    head = b""
    while not head.endswith(b"\r\n\r\n"):
        line = file.readline()
        if not line:
            raise ValueError("a WARC record is cut off")
        head += line
    headers = parse_headers(head[:-4])
    length = int(headers.get("content-length", "0"))
    take = wanted(headers)
    if take and with_payload:
        yield headers, _payload(file.read(length), headers)
    else:
        file.seek(length, 1)
        if take:
            yield headers, None
    file.seek(4, 1)


# --- reading -------------------------------------------------------------------------------


@dataclass
class FilePartition(InputPartition):
    files: list[str]


def _holds(test: tuple[str, str, object], headers: dict[str, str]) -> bool:
    kind, header, value = test
    have = headers.get(header)
    if have is None:
        return False
    if kind == "eq":
        return have == value
    if kind == "in":
        return have in value
    if kind == "starts":
        return have.startswith(value)
    if kind == "ends":
        return have.endswith(value)
    return kind == "set" or value in have


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            header = HEADER_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if header and isinstance(f, EqualTo) and isinstance(value, str):
                self.tests.append(("eq", header, value))
            elif header and isinstance(f, In) and all(isinstance(v, str) for v in value):
                self.tests.append(("in", header, tuple(value)))
            elif header and isinstance(f, StringStartsWith):
                self.tests.append(("starts", header, value))
            elif header and isinstance(f, StringEndsWith):
                self.tests.append(("ends", header, value))
            elif header and isinstance(f, StringContains):
                self.tests.append(("has", header, value))
            elif header and isinstance(f, IsNotNull):
                self.tests.append(("set", header, None))
            else:
                yield f

    def partitions(self):
        """Files in order, joined into partitions of about the wanted size."""
        from pyarrow import fs

        files, root = _files(self.path)
        listed = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
        named = {i.path: i.size for i in listed}
        manifests = [p for p in named if p.rsplit("/", 1)[-1].startswith("_manifest-")]
        if manifests:  # only what was committed
            paths = []
            for m in manifests:
                with files.open_input_stream(m) as f:
                    paths += [f"{root}/{name}" for name in json.loads(f.read())]
        else:
            paths = [p for p in named if p.endswith((".warc", ".warc.gz"))]
        out, size = [[]], 0
        for p in sorted(paths):
            if out[-1] and size + named[p] > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(p)
            size += named[p]
        return [FilePartition(x) for x in out]

    def read(self, partition):
        files, _ = _files(self.path)
        tests = self.tests
        schema = pa.schema(
            [
                *[(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "refers_to")],
                ("payload_digest", pa.string()),
                ("payload_length", pa.int64()),
                ("content_type", pa.string()),
                ("headers", pa.map_(pa.string(), pa.string())),
                ("payload", pa.binary()),
            ]
        )
        rows, size = [], 0
        for path in partition.files if partition else ():
            with files.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
                for headers, payload in records(file, lambda h: all(_holds(t, h) for t in tests), self.with_payload):
                    row = {c: headers.get(h) for c, h in HEADER_OF.items()}
                    length = headers.get("x-payload-length")
                    row["payload_length"] = int(length) if length else None
                    row["headers"] = list(headers.items())
                    row["payload"] = payload
                    rows.append(row)
                    size += len(payload or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# --- writing -------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, refers_to, payload_digest,
    payload_length, payload) into archives. Files get fresh names; only those in
    the manifest written on commit count, so a task that ran twice leaves no
    second copy of its records."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in cols.items()}
                revisit = row["record_type"] == "revisit"
                length = row["payload_length"]
                fields = [
                    ("WARC-Type", row["record_type"]),
                    ("WARC-Record-ID", row["record_id"]),
                    ("WARC-Date", self.date),
                    ("WARC-Target-URI", row["target_uri"]),
                    ("WARC-Payload-Digest", row["payload_digest"]),
                    ("WARC-Refers-To", row["refers_to"]),
                    ("WARC-Profile", REVISIT_PROFILE if revisit else None),
                    ("X-Payload-Length", None if length is None else str(length)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                packed = member(record(fields, HTTP_HEAD + (b"" if revisit else row["payload"] or b"")))
                if out is None or size + len(packed) > self.file_bytes:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(packed)
                size += len(packed)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        old = []
        if self.overwrite:
            old = [i.path for i in files.get_file_info(fs.FileSelector(root)) if "/_manifest-" in i.path]
        names = [n for m in messages if m for n in m.files]
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(names).encode())
        for p in old:
            files.delete_file(p)

    def abort(self, messages):
        files, root = _files(self.path)
        for m in messages:
            for n in m.files if m else ():
                files.delete_file(f"{root}/{n}")


# Fixed value: the revisit profile's name in the WARC 1.1 specification.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``. Filters on the record type and
    the other header columns are applied while headers are read; with
    ``payload=False`` no payload is decoded and the column is null. A folder with
    no archive gives no rows; a record that is cut off fails the read."""
    reader = _registered(spark).read.format(FORMAT)
    return reader.option("path", path).option("payload", str(payload).lower()).load()


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for every row of ``pages``: the payload in UTF-8 (null:
    empty), its id and uri as headers. Of equal payloads of at least
    ``min_revisit_bytes`` bytes, the row with the smallest id is the response and
    the others revisit it; smaller ones are all responses.

    Only digests are grouped, with partial counts before the shuffle. Groups of more
    than one are joined back; a hot digest is one row on that side, so a skewed
    join can be split. Rows that share the smallest id with an equal payload
    (repeated rows) are all responses. Rows without an id are never referred to:
    beside a row with an id they revisit it, among themselves they are responses.
    A null uri has no header. Extra columns are ignored; an empty table gives an
    archive without records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(uri_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn(
        "payload_length", F.octet_length("payload").cast("long")
    )
    shared = (
        rows.where(F.col("payload_length") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    joined = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = joined.select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.format_string("<urn:record:%d>", "id").alias("record_id"),
        "target_uri",
        F.when(revisit, F.format_string("<urn:record:%d>", "first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).withColumn("record_id", F.when(F.col("record_id") != "<urn:record:null>", F.col("record_id")))
    _registered(pages.sparkSession)
    out.write.format(FORMAT).mode("append").option("path", path).option("date", date).save()
