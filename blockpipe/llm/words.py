"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 19


def normal_words(text: Column) -> Column:
    """Lower-cased letters and digits, every other run one blank, a blank at the
    end. Null counts as empty."""
    padded = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    return F.regexp_replace(F.lower(padded), r"[^\p{L}\p{N}]+", " ")


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the blank-separated words in a buffer of bytes.

    A word's hash is a polynomial in a random odd base over random values of its
    bytes; prefix sums give all words' polynomials in a few array operations.
    """

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(20240517))
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        self.up, self.down = self._powers(base), self._powers(pow(base, -1, 2**64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        powers = np.full(CHUNK_BYTES + 1, base, dtype=np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)

    def _chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = np.concatenate(([True], data == 32, [True]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, byte positions) of all words, in order. The buffer is worked
        off in pieces cut at blanks, so memory is bounded; a word longer than a
        piece is hashed piecewise."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            stop = min(at + CHUNK_BYTES, len(data))
            if stop < len(data):
                blanks = np.flatnonzero(data[at:stop] == 32)
                if len(blanks):
                    stop = at + int(blanks[-1]) + 1
            h, s = self._chunk(data[at:stop])
            hashes.append(h)
            starts.append(s + at)
            at = stop
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, first word of each text and the end) for an Arrow array
        of normalised texts, each ending in a blank."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        hashes, starts = self.words(data)
        return hashes, np.searchsorted(starts, offsets - offsets[0])


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a text with fewer has one, of all its words."""
    k = min(k, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * _ODD[j % len(_ODD)]
    return mix(out)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def text_groups(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts come to about ``most_bytes``; a longer
    text is a range of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > most_bytes:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)
