"""Benchmark passages in documents, by SimHash of item-sized windows.

Every item is fingerprinted by windows a little shorter than itself, taken at its
start, its middle and its end; every window of that many words in every document is
fingerprinted too, from running sums over the words' bits. Fingerprints within a
Hamming radius are found through blocks: with ``BLOCKS`` blocks and a radius below
twice their number, some block differs in at most one bit, so looking up each
block and its one-bit neighbours misses none. Candidates are verified exactly by
the weighted similarity of word shingles over a window as long as the item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.words import SHINGLE_WORDS, WordHasher, normal_words, shingles, text_groups

THRESHOLD = 0.8
RADIUS = 7
BLOCKS = 4  # of 16 bits; RADIUS < 2 * BLOCKS
WINDOW_SHARE = 0.85  # a window has at most this share of its item's words
WINDOW_STEP = 1.25  # from one window size to the next
ITEM_BLOCK = 20_000  # items looked for in one pass over the documents
CHUNK_WORDS = 1 << 15
MOST_COUNT = (1 << 16) - 1

HITS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def window_sizes(most: int) -> list[int]:
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * WINDOW_STEP)))
    return sizes


def window_size(n: int, sizes: list[int]) -> int:
    """The largest size of at most ``WINDOW_SHARE`` of ``n`` words, 1 at least."""
    return max([s for s in sizes if s <= max(1, n * WINDOW_SHARE)])


def running_bits(words: np.ndarray, most: int) -> np.ndarray:
    """Running counts of the words' set bits, one column for each of 64 bits, modulo
    2^8 for windows of up to ``most`` < 2^8 words, else modulo 2^16 (windows are
    shorter than that). Four 16-bit columns are summed as one number, for at most
    ``MOST_COUNT`` words at a time, so none runs over into the next."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(words) + 1, 64), dtype=np.uint8 if most < 1 << 8 else np.uint16)
    for at in range(0, len(words), MOST_COUNT):
        four = bits[at : at + MOST_COUNT].astype(np.uint16).view(np.uint64)
        part = np.cumsum(four, axis=0).view(np.uint16).astype(sums.dtype)
        sums[at + 1 : at + 1 + len(part)] = part + sums[at]
    return sums


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words: a bit is set if more than half
    of the window's words have it."""
    ones = sums[size:] - sums[:-size]
    return np.packbits((ones > size // 2).ravel()).view(np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Of two shingle multisets: common weight over total weight, a shingle's
    weight being how often it occurs."""
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


class Index:
    """The items of one pass: by window size, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, w, Counter(shingles(w).tolist())) for i, w in items if len(w)]
        sizes = window_sizes(max((len(w) for _, w, _ in self.items), default=1))
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words, _) in enumerate(self.items):
            size = window_size(len(words), sizes)
            prints = fingerprints(running_bits(words, size), size)
            for offset in sorted({0, (len(words) - size) // 2, len(words) - size}):
                entries.setdefault(size, []).append((int(prints[offset]), k, offset))
        self.classes = [self._class(size, rows) for size, rows in sorted(entries.items())]
        self.most = max(entries, default=1)

    @staticmethod
    def _class(size: int, rows: list[tuple[int, int, int]]):
        prints = np.array([r[0] for r in rows], dtype=np.uint64)
        blocks = []
        flips = np.concatenate(([0], 1 << np.arange(16))).astype(np.uint64)
        for b in range(BLOCKS):
            keys = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF))[:, None] ^ flips[None, :]
            keys = keys.ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange(65537))
            blocks.append((starts[1:] > starts[:-1], starts, (order // len(flips)).astype(np.int64)))
        return size, prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window start, window size, entry's item and offset) within the radius."""
        at = 0
        while at < len(words):
            part = words[at : at + CHUNK_WORDS + self.most - 1]
            sums = running_bits(part, self.most)
            for size, prints, items, offsets, blocks in self.classes:
                if len(part) < size:
                    continue
                found = fingerprints(sums, size)[:CHUNK_WORDS]
                pairs = []
                for b, (known, starts, order) in enumerate(blocks):
                    keys = (found >> np.uint64(16 * b)).astype(np.uint16)
                    hit = np.flatnonzero(known[keys])
                    if not len(hit):
                        continue
                    keys = keys[hit].astype(np.int64)
                    first, many = starts[keys], starts[keys + 1] - starts[keys]
                    where = np.repeat(hit, many)
                    step = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
                    entry = order[np.repeat(first, many) + step]
                    near = np.bitwise_count(found[where] ^ prints[entry]) <= RADIUS
                    pairs.append(where[near] * len(prints) + entry[near])
                for pair in np.unique(np.concatenate(pairs)) if pairs else ():
                    where, entry = divmod(int(pair), len(prints))
                    yield at + where, size, int(items[entry]), int(offsets[entry])
            at += CHUNK_WORDS

    def hits(self, words: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) for the texts that lie
        between ``bounds`` in ``words``: of a text and an item the most similar
        window, of equal ones the first."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        seen = set()
        for start, size, k, offset in self.candidates(words):
            d = int(np.searchsorted(bounds, start, side="right")) - 1
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            if start + size > hi:
                continue  # the window runs into the next text
            n = min(len(self.items[k][1]), hi - lo)
            first = min(max(start - offset, lo), hi - n)
            if (first, k) in seen:
                continue
            seen.add((first, k))
            similarity = weighted_similarity(Counter(shingles(words[first : first + n]).tolist()), self.items[k][2])
            if similarity >= threshold:
                rank = (similarity, lo - first, n)
                if (d, k) not in best or rank > best[d, k]:
                    best[d, k] = rank
        for (d, k), (similarity, back, n) in best.items():
            yield d, k, similarity, -back, n


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """A row for every document and benchmark item of which the document holds a
    passage: doc_id, item_id, similarity (at least ``threshold``, over shingles of
    five words), first_word and n_words of the most similar window.

    Words are lower-cased runs of letters and digits. An item of fewer than five
    words is one shingle of all its words, so it is found word for word; items
    without words are never found. Null and empty texts hold no passage, repeated
    rows give repeated hits, other columns are ignored, and an empty table on
    either side gives an empty result.

    Documents stay where they are: one pass over them for each ``item_block``
    items, whose index (some hundred bytes for each item) is what tasks receive, so
    its size is bound however many items there are. Whole texts are read in
    pieces of bounded size.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_words(F.col(text_col)).alias("w"))
    found = None
    for rows in _item_blocks(benchmark, item_col, item_text_col, item_block):
        hits = texts.mapInArrow(_searcher(rows, threshold), HITS)
        found = hits if found is None else found.unionAll(hits)
    return found


def flag_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    flag: str = "contaminated",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``docs`` plus a boolean column: whether the text holds a passage of any item,
    by the rules of ``find_passages``; false for null and empty texts. Rows are judged
    where they are, so ids may be null or repeated. A column named like the flag is
    replaced."""
    row = F.struct(*[docs[c] for c in docs.columns if c != flag]).alias("__row")
    out = docs.select(row, F.col(text_col).alias("__text"))
    hit = F.lit(False)
    for k, rows in enumerate(_item_blocks(benchmark, item_col, item_text_col, item_block)):
        out = out.withColumn(f"__hit{k}", _flagger(rows, threshold)(normal_words(F.col("__text"))))
        hit = hit | F.col(f"__hit{k}")
    return out.select("__row.*", hit.alias(flag))


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, item_block: int) -> Iterator[pa.Table]:
    """The items (id, words) in tables of about ``item_block``, one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), normal_words(F.col(text_col)).alias("w"))
    items = items.where("i is not null")
    passes = max(1, math.ceil(items.count() / item_block))
    for p in range(passes):
        yield items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).toArrow()


def _built(rows: pa.Table, hasher: WordHasher) -> Index:
    texts = pa.chunked_array(rows.column(1).chunks, pa.string()).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks or [pa.array([], pa.string())])
    words, bounds = hasher.documents(texts)
    return Index([(i, words[lo:hi].copy()) for i, lo, hi in zip(rows.column(0).to_pylist(), bounds[:-1], bounds[1:])])


def _searcher(rows: pa.Table, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        index = _built(rows, hasher)
        for batch in batches:
            out = []
            for lo, hi in text_groups(batch, 1):
                part = batch.slice(lo, hi - lo)
                words, bounds = hasher.documents(part.column(1))
                doc_ids = part.column(0).to_pylist()
                for d, k, similarity, first, n in index.hits(words, bounds, threshold):
                    out.append((doc_ids[d], index.items[k][0], similarity, first, n))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            names = ("doc_id", "item_id", "similarity", "first_word", "n_words")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return search


def _flagger(rows: pa.Table, threshold: float):
    @F.arrow_udf("boolean")
    def flagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        index = _built(rows, hasher)
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["w"])
            out = np.zeros(len(texts), dtype=bool)
            for lo, hi in text_groups(batch, 0):
                words, bounds = hasher.documents(batch.column(0).slice(lo, hi - lo))
                for d, *_ in index.hits(words, bounds, threshold):
                    out[lo + d] = True
            yield pa.array(out)

    return flagged
