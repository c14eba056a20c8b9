"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDERS = (3, 4, 5)
PIECE_CHARS = 1 << 17


def pieces(texts: list[str], most: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(owners, pieces): all texts, cut after a blank where longer than about ``most``
    characters, in groups of about as many. An n-gram lies inside a word, so the pieces
    have just the text's n-grams. Where a text is cut depends on nothing else; a word
    longer than ``most`` stays whole."""
    owners, group, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text)
            if end - at > most:
                end = text.rfind(" ", at, at + most) + 1 or text.find(" ", at + most) + 1 or len(text)
                end = end if end > at else len(text)
            if group and held + end - at > most:
                yield np.array(owners), group
                owners, group, held = [], [], 0
            owners.append(i)
            group.append(text[at:end])
            held, at = held + end - at, end
            if not text:
                break
    if group:
        yield np.array(owners), group


def ngrams(texts: list[str], bits: int, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram inside a word, blanks at the word's edges
    included. Texts are normalised words, each text ending in a blank. Buckets are
    below ``2 ** bits``; owners are indexes into ``texts``, not in order."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer((" " + "".join(texts)).encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    owner = np.append(np.repeat(np.arange(len(texts), dtype=np.int32), lengths), np.int32(len(texts) - 1))
    inner = np.append(np.uint32(0), np.cumsum(chars == 32, dtype=np.uint32))  # blanks before a place
    owners, buckets = [], []
    rolling = chars * np.uint32(0x9E3779B1)
    have = 1
    for n in sorted(orders):
        if len(chars) < n:
            break
        while have < n:
            rolling = (rolling[: len(chars) - have] ^ chars[have:]) * np.uint32(0x85EBCA6B)
            rolling ^= rolling >> np.uint32(13)
            have += 1
        places = np.flatnonzero(inner[n - 1 : len(chars)] == inner[1 : len(chars) - n + 2])
        h = rolling[places] * np.uint32(0xC2B2AE35) + np.uint32(n)
        buckets.append((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits))
        owners.append(owner[places])
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(owners), np.concatenate(buckets)


def counted(owner: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket, times): each owner's distinct buckets, ordered by owner, and
    how often each occurs."""
    keys = (owner.astype(np.uint64) << np.uint64(bits)) | bucket.astype(np.uint64)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), times
