"""Best-fit packing planned on the length histogram.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` counts) is planned: best-fit decreasing places
whole counts at a time and notes runs of slots. Pieces then take slots by their
rank among the pieces of the same length, so packing any number of documents is a
ranking and a join.
"""

from __future__ import annotations

import bisect
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockpipe.llm.common import written
from blockpipe.llm.words import text_groups

CAPACITY = 4096
END_ID = 1
RANK_ROWS = 1_000
CACHED_CHUNKS = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

# The vocabulary file's own pattern for words, and the characters
# whose normal form and lower case are taken here instead of by the tokenizer
# (ASCII, Latin-1 letters, common typographic signs). Texts with any other
# character, or with a special token's opening, go to the tokenizer whole.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "\t\n\r -~À-ÖØ-öø-ÿ–—‘’“”…€"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: a printable Latin-1
    character stands for itself, the other bytes take the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Blank-free stretch of lower-cased text -> its ids as little-endian unsigned
    32-bit bytes, found on demand: split into words, each merged by the vocabulary."""

    def __init__(self, tokenizer, limit: int):
        self.merge, self.limit = tokenizer.model.tokenize, limit
        self.split = regex.compile(WORD).findall
        self.letters = byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        found = []
        for word in self.split(chunk):
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            found += [t.id for t in self.merge(word)]
        ids = np.asarray(found, dtype="<u4").tobytes()
        if len(self) < self.limit:  # the frequent ones come early
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode`` gives. No word of the
    vocabulary spans a blank, so the ids of a stretch between blanks are found once
    and kept."""

    def __init__(self, path: str, limit: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = ChunkIds(self.tokenizer, limit)
        self.odd = re.compile(f"[^{PLAIN}]|<\\|").search

    def ids(self, text: str) -> bytes:
        if self.odd(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.asarray(found, dtype="<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def _encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary, so that later tasks of the
    process find the chunks it knows."""
    kept = sys.modules.setdefault("blockpipe_worker_state", types.ModuleType("blockpipe_worker_state"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders.clear()  # one at a time
        encoders[path] = Encoder(path)
    return encoders[path]


def tokenize(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of every document: its ids, then ``end_id``, cut only if longer than
    ``capacity``. Columns: doc_id, piece, start, length, ids_crc32 and ids (little-
    endian unsigned 32-bit; null unless ``with_ids``). A null text counts as empty
    and gives the one piece ``[end_id]``; repeated rows give repeated pieces."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(vocabulary)
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def table(rows):
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for lo, hi in text_groups(batch, 1):
                part, rows = batch.slice(lo, hi - lo), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (encoder.ids(text) if text else b"") + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at : at + step]
                        rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                yield table(rows)

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return chosen.mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first, last, bin, per_bin,
    base): pieces of this length with ranks first..last-1 go to bins from ``bin``
    on, ``per_bin`` to each, from offset ``base`` on.

    Equal bins are kept as runs (first bin, how many) by the room they have left.
    Of equal pieces, best fit puts as many as fit into one bin before it opens the
    next, since that bin then has the least room; so a run is filled in one step.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted keys of runs
    bins = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append(run)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:  # new bins
                room, first = capacity, bins
                many = -(-todo // (capacity // length))
                bins += many
            each = room // length
            full = min(many, todo // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, todo = rank + full * each, todo - full * each
                put(room - each * length, (first, full))
                first, many = first + full, many - full
            if todo and many:  # fewer left than fit into one bin
                rows.append((length, rank, rank + todo, first, todo, capacity - room))
                put(room - todo * length, (first, 1))
                first, many, rank, todo = first + 1, many - 1, rank + todo, 0
            put(room, (first, many))
    return rows


def ranked_by_length(pieces: DataFrame, histogram: dict[int, int], rank_rows: int) -> DataFrame:
    """``pieces`` plus ``__rank``, gapless from 0 among the pieces of a length. A
    length that many pieces share is ranked in parts of about ``rank_rows``, whose
    counts give the ranks' starts, so it is not one task's work. The table of how
    many parts a length has is bound by the capacity and broadcast."""
    spark = pieces.sparkSession
    parts = spark.createDataFrame([(n, -(-c // rank_rows)) for n, c in histogram.items()], "length long, __parts long")
    # repeated rows are told apart by their place in the written table
    pieces = pieces.withColumn("__place", F.monotonically_increasing_id())
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32", "__place")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("__salt", F.pmod(mixed, F.col("__parts")))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__start")).drop(
        "__salt", "__start", "__parts", "__place"
    )


def assign(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) plus ``sequence_id`` and
    ``offset``. Only the histogram reaches the driver: one count for each length
    of at most ``capacity``. The plan has a few rows for each length and is
    broadcast; its size is bound by ``capacity``, not by the corpus."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(
        rows, "length long, __first long, __last long, __bin long, __each long, __base long"
    )
    taken = ranked_by_length(pieces, histogram, rank_rows).join(F.broadcast(slots), "length")
    taken = taken.where("__rank >= __first and __rank < __last")
    nth = F.col("__rank") - F.col("__first")
    return taken.withColumn("sequence_id", F.col("__bin") + F.floor(nth / F.col("__each"))).withColumn(
        "offset", F.col("__base") + nth % F.col("__each") * F.col("length")
    ).drop("__rank", "__first", "__last", "__bin", "__each", "__base")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length,
    ids_crc32, ids, sequence_id, offset. Pieces are tokenized once and written to
    the shared folder; planning and ranking read their lengths only.

    Null and empty texts are one piece of the end id; a null doc_id is kept;
    repeated rows are packed as often as they occur; other columns of ``docs``
    are ignored; an empty table gives an empty result.
    """
    pieces = written(tokenize(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), "pieces")
    placed = assign(pieces, capacity)
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    return placed.select(*[F.col(c).cast("long") if c in ("sequence_id", "offset") else F.col(c) for c in order])
