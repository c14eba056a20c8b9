"""Near duplicates by Order MinHash, verified by banded alignment.

Every text is a sequence of five-word shingles, each labelled with its occurrence
number in the text. A sketch takes the ``MINIMA`` smallest labelled shingles under a
random order and keeps them in text order, so two texts agree on it if they share
these shingles in the same order. Texts that agree on any of ``SKETCHES`` sketches are
candidates. A candidate pair is linked if its shingle sequences align well: with L
matched shingles on the best alignment, similarity is L / (n1 + n2 - L), the Jaccard
similarity of shingles when they must match in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.common import written
from blockpipe.llm.components import connected_components
from blockpipe.llm.words import SHINGLE_WORDS, WordHasher, mix, normal_words, shingles, text_groups

THRESHOLD = 0.8
SKETCHES = 16
MINIMA = 3
BLOCK_TEXTS = 256

_MOST = np.uint64(2**64 - 1)


# --- sketches ------------------------------------------------------------------------------


def occurrences(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many equal values of the same owner precede each value."""
    own = mix(owner.astype(np.uint64) + np.uint64(1)) ^ values
    ordered = np.sort(own)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    number = np.zeros(len(values), dtype=np.uint64)
    if len(again):
        at = np.flatnonzero(np.isin(own, again))
        order = at[np.argsort(own[at], kind="stable")]
        runs = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        lengths = np.diff(np.append(runs, len(order)))
        number[order] = np.arange(len(order)) - np.repeat(runs, lengths)
    return number


def order_minhash(
    words: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA
) -> np.ndarray:
    """One row of ``sketches`` keys for each text; a text without words has zeros."""
    out = np.zeros((len(bounds) - 1, sketches), dtype=np.uint64)
    parts = [shingles(words[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    texts = np.flatnonzero(sizes)
    if not len(texts):
        return out
    values, sizes = np.concatenate([parts[t] for t in texts]), sizes[texts]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    labelled = mix(values + occurrences(values, owner) * np.uint64(0x9E3779B97F4A7C15))
    rng = np.random.Generator(np.random.PCG64(77))
    for j in range(sketches):
        xor, odd = rng.integers(0, 2**63, 2, dtype=np.uint64)
        rank = (labelled ^ xor) * (odd | np.uint64(1))
        rank ^= rank >> np.uint64(31)
        places = np.empty((minima, len(texts)), dtype=np.int64)
        for l in range(minima):
            least = np.minimum.reduceat(rank, starts)
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            place = hits[np.searchsorted(hits, starts)]
            rank[place] = _MOST
            places[l] = np.where(l < sizes, place, len(values))  # a short text has fewer
        places.sort(axis=0)
        key = np.full(len(texts), j + 1, dtype=np.uint64)
        padded = np.append(values, np.uint64(0))
        for l in range(minima):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + padded[places[l]])
        out[texts, j] = key
    return out


# --- alignment -----------------------------------------------------------------------------


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """L / (len(a) + len(b) - L) for the longest common subsequence L of two shingle
    sequences if that is at least ``threshold``, else 0.

    The threshold says how many elements may stay unmatched on either side, hence
    how far an alignment can leave the diagonal; only that band is computed, bit by
    bit in parallel: a bit of the band's column is 0 where the alignment gains a match.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    if need > min(n, m):
        return 0.0
    matched, same = 0, a[: min(n, m)] == b[: min(n, m)]
    head = int(np.argmin(same)) if not same.all() else len(same)
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    tail = (int(np.argmin(same)) if not same.all() else short) if short else 0
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    above, below = n - need, m - need  # elements of a, of b that may stay unmatched
    width = above + below + 1
    full = (1 << width) - 1
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    often = 32 + len(a) // 1024
    masks = {x: sum(1 << i for i in p) for x, p in places.items() if len(p) > often}
    column, low = full, -below
    for y in b:
        mask = 0
        if y in masks:
            mask = (masks[y] >> low if low >= 0 else masks[y] << -low) & full
        else:
            for i in places.get(y, ()):
                if 0 <= i - low < width:
                    mask |= 1 << (i - low)
        if mask:
            hit = column & mask
            column = ((column + hit) | (column - hit)) & full
        matched += 1 - (column & 1)
        column = (column >> 1) | (1 << (width - 1))
        low += 1
    matched += width - column.bit_count() + head + tail
    return matched / (n + m - matched) if matched >= need else 0.0


def _bytes(texts) -> pa.Array:
    return pa.array(texts, pa.large_string())


def pair_similarity(threshold: float):
    """Pandas UDF: aligned similarity of two normalised texts."""

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hasher = WordHasher()
        for left, right in batches:
            out = []
            for at in range(0, len(left), 64):
                a, ab = hasher.documents(_bytes(left[at : at + 64]))
                b, bb = hasher.documents(_bytes(right[at : at + 64]))
                for i in range(len(ab) - 1):
                    x, y = shingles(a[ab[i] : ab[i + 1]]), shingles(b[bb[i] : bb[i + 1]])
                    out.append(aligned_similarity(x, y, threshold))
            yield pd.Series(out, dtype="float64")

    return similarity


def _common(values: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Numbers of common values of the texts in ``rows`` with all texts."""
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    total = np.zeros((len(rows), len(values)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    most = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, most, 4096):
        first, last = np.searchsorted(code, (lo, lo + 4096))
        has = np.zeros((len(values), min(4096, most - lo)), dtype=np.float32)
        has[owner[first:last], code[first:last] - lo] = 1
        total += has[rows] @ has.T
    return total


def block_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between texts of a block pair that are not yet known to be connected.
    Numbers of common labelled shingles bound the alignment from above; only pairs
    that pass are aligned, and only until their components are one."""
    hasher = WordHasher()
    pdf = pdf.drop_duplicates("id").sort_values("id")
    words, bounds = hasher.documents(_bytes(pdf["w"]))
    plain = [shingles(words[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
    labelled = [mix(v + occurrences(v, np.zeros(len(v))) * np.uint64(0x9E3779B97F4A7C15)) for v in plain]
    ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
    root = {int(c): int(c) for c in pdf["comp"].unique()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    comp = [int(c) for c in pdf["comp"]]
    commonest = pdf["comp"].mode().iloc[0]
    rows = np.flatnonzero(pdf["comp"].to_numpy() != commonest)  # every pair of two components has one of these
    found, lengths = [], np.array([len(v) for v in plain])
    if len(rows):
        common = _common(labelled, rows)
        need = np.ceil(threshold / (1 + threshold) * (lengths[rows][:, None] + lengths[None, :]) - 1e-6)
        apart = block[rows][:, None] != block[None, :] if len(np.unique(block)) > 1 else True
        for r, j in zip(*np.nonzero((common >= need) & apart)):
            i = int(rows[r])
            if i == j or find(comp[i]) == find(comp[j]):
                continue
            if aligned_similarity(plain[i], plain[j], threshold):
                root[find(comp[i])] = find(comp[j])
                found.append((int(ids[i]), int(ids[j])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


# --- the operator --------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    sketches: int = SKETCHES,
    minima: int = MINIMA,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """(doc_id, class_id, keep), one row for each row of ``docs``: documents linked
    directly or through others have the same class, named after its smallest id;
    ``keep`` marks the document of that id.

    1. Texts with the same words (letters and digits, case ignored) are one text;
       of texts without any word, equal ones are. All later work is on distinct texts.
    2. Texts that share a sketch key form a bucket. Each is aligned with the bucket's
       smallest id, so a bucket of any size gives one candidate each, not all pairs.
    3. Where a bucket still has texts of different components, its texts meet in
       blocks of about ``block_texts``: pairs between components that pass an upper
       bound on the alignment are aligned. So no linked candidate pair is left apart,
       and none is written out but for links found. Members of a bucket's largest
       component only meet the others, so the work grows with the number of texts
       times that of texts outside it.

    A key that many rows share costs a skewed join, which is split; counts and minima
    are formed before any shuffle. Texts are shuffled only for candidates.

    A null text is a class of its own. A null id never names a class: such a row joins
    the class of the same words if a row with an id has them, else its class is null.
    Rows with one id count as one document in links. Other columns of ``docs`` are
    ignored. An empty table gives an empty result.
    """
    text = F.col(text_col)
    words = normal_words(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words.alias("w"), text.alias("t"))
    same = F.when(F.col("w").isin("", " "), F.concat(F.lit("="), "t")).otherwise(F.concat(F.lit(" "), "w"))
    keyed = rows.select("id", F.when(F.col("t").isNotNull(), F.unhex(F.md5(same))).alias("key"), "w")
    base = written(keyed.mapInArrow(_sketcher(sketches, minima), "id long, key binary, sketch array<long>"), "sketches")

    distinct = written(
        base.where("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.any_value("sketch").alias("sketch"))
        .where("rep is not null"),
        "distinct-texts",
    )
    buckets = distinct.select("rep", F.explode("sketch").alias("bucket")).where("bucket <> 0")
    stats = buckets.groupBy("bucket").agg(
        F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("rep")).alias("mark"),
    ).where("n > 1")
    # buckets with the same texts say the same
    stats = stats.groupBy("pivot", "last", "n", "mark").agg(F.min("bucket").alias("bucket"))
    shared = written(buckets.join(stats, "bucket").select("bucket", "rep", "pivot", "n"), "buckets")

    pairs = written(shared.where("rep <> pivot").select("rep", "pivot").distinct(), "pairs")
    needed = pairs.select(F.col("rep").alias("id")).unionAll(pairs.select(F.col("pivot").alias("id"))).distinct()
    # a merge join at every size, so that the work grows with the input and no faster
    texts = written(rows.select("id", "w").join(needed.hint("merge"), "id", "left_semi"), "candidate-texts")
    sim = pair_similarity(threshold)
    left = texts.select(F.col("id").alias("rep"), F.col("w").alias("lw"))
    right = texts.select(F.col("id").alias("pivot"), F.col("w").alias("rw"))
    compared = pairs.join(left, "rep").join(right, "pivot").withColumn("similarity", sim("lw", "rw"))
    links = written(compared.where(F.col("similarity") >= threshold).select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "near-links")
    first = written(connected_components(links), "first-components")

    member = shared.where("n > 2").join(first.withColumnRenamed("id", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("comp")
    )
    parts = member.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1")
    apart = _dealt(member, mixed, block_texts)
    met = apart.join(texts.withColumnRenamed("id", "rep"), "rep").select(
        "bucket", "i", "j", F.col("rep").alias("id"), "comp", "block", "w"
    )
    more = met.groupBy("bucket", "i", "j").applyInPandas(lambda pdf: block_links(pdf, threshold), "a long, b long")
    final = connected_components(links.unionAll(more)).withColumnRenamed("id", "rep")

    own = base.join(distinct.select("key", "rep"), "key", "left")
    classed = own.join(final, "rep", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep")).alias("class_id"),
    )
    return classed.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _dealt(member: DataFrame, mixed: DataFrame, block_texts: int) -> DataFrame:
    """Members of buckets with several components, dealt to pairs of blocks (i, j) in
    which every two of different components meet. The largest component's members
    need only meet the others, so they are copied once for each block of others: a
    bucket whose texts are nearly all linked costs hardly more than its size. A bucket
    that fits into one block is one."""
    one = F.col("n") <= block_texts
    sized = mixed.select(
        "bucket",
        F.col("main.comp").alias("main"),
        F.when(one, 0).otherwise(F.ceil(F.col("main.n") / block_texts)).cast("int").alias("mains"),
        F.when(one, 1).otherwise(F.ceil((F.col("n") - F.col("main.n")) / block_texts)).cast("int").alias("others"),
    )
    rows = member.join(sized, "bucket").withColumn(
        "is_main", (F.col("comp") == F.col("main")) & (F.col("mains") > 0)
    )
    rows = rows.withColumn("b", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    rows = rows.withColumn("block", F.when(F.col("is_main"), F.col("b")).otherwise(F.col("mains") + F.col("b")))
    # blocks of the main component are numbered from 0, the others' after them
    all_others = F.sequence(F.lit(0), F.col("others") - 1)
    to_main = F.transform(all_others, lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    later = F.filter(
        F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1), lambda j: (j < F.col("mains")) | (j >= F.col("block"))
    )
    own = F.transform(later, lambda j: F.struct(F.col("b").alias("i"), j.alias("j")))
    earlier = F.filter(all_others, lambda x: x < F.col("b"))
    to_own = F.transform(earlier, lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    pairs = F.when(F.col("is_main"), to_main).otherwise(F.concat(own, to_own))
    return rows.select("bucket", "rep", "comp", "block", F.explode(pairs).alias("p")).select(
        "bucket", "rep", "comp", "block", "p.i", "p.j"
    )


def _sketcher(sketches: int, minima: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for lo, hi in text_groups(batch, 2, 1 << 20):
                part = batch.slice(lo, hi - lo)
                words, bounds = hasher.documents(part.column(2))
                keys = order_minhash(words, bounds, sketches, minima).view(np.int64)
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * sketches)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists], names=["id", "key", "sketch"]
                )

    return sketch
