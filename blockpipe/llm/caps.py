"""Near duplicates among embeddings, by spherical-cap filters.

Filters are directions; a vector belongs to every filter whose cap holds it, that is
whose inner product with it reaches a bound. The directions form ``CODES`` product
codes. Each turns the space at random (signs and Hadamard transforms, thrice) and cuts
it into two halves with ``directions`` random unit vectors each; every pair of these code
words is a direction. Its inner product is the sum of the halves', so a vector is
list-decoded to all exceeding directions from two short lists of scores, without looking
at the others. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.common import dealt_in_blocks, whole_groups, written
from blockpipe.llm.components import connected_components

THRESHOLD = 0.9
RECALL = 0.999  # of pairs at exactly the threshold; nearer ones are found more surely
CODES = 32  # of independent turns: many small codes need fewer filters for a recall than a large one
BUCKET_VECTORS = 1024  # vectors of a filter that the code's size aims at
BLOCK_VECTORS = 2048
MOST_DIRECTIONS = 1024  # of each half: 33.6 million filters
LEAST_DIMENSIONS = 8  # shorter vectors are padded with zeros before they are turned
SAMPLE_PAIRS = 4000
BEST_WORDS = 32


def directions_for(vectors: int, bucket_vectors: int = BUCKET_VECTORS) -> int:
    """Code words of a half, so that a filter holds about ``bucket_vectors`` of that
    many vectors: of each code a vector belongs to 0.6 filters or a little more."""
    return min(MOST_DIRECTIONS, max(2, math.ceil(math.sqrt(0.6 * vectors / bucket_vectors))))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish and no
    digit changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two, scaled so
    that lengths stay."""
    n, width, step = len(rows), rows.shape[1], 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2)
        step *= 2
    return rows.reshape(n, width) / math.sqrt(width)


class ProductCode:
    """The filters for vectors of one dimension; equal arguments give equal filters."""

    def __init__(self, dimensions: int, directions: int, threshold: float, recall: float, codes: int = CODES):
        self.directions, self.codes = directions, codes
        self.threshold, self.recall = threshold, recall
        self.width = 1 << math.ceil(math.log2(max(dimensions, LEAST_DIMENSIONS)))
        rng = np.random.Generator(np.random.PCG64([dimensions, directions, 11]))
        words = []
        for _ in range(codes):
            halves = np.zeros((2, directions, 2, self.width // 2))
            for h in (0, 1):
                halves[h, :, h] = unit(rng.normal(size=(directions, self.width // 2)))
            turned = halves.reshape(2 * directions, self.width)
            for _ in range(3):
                turned = hadamard(turned) * rng.choice([-1.0, 1.0], self.width)
            words.append(turned)
        self.words = np.stack(words)  # of each code, the words of the first and of the second half
        self.rng = rng

    def scores(self, rows: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors, the inner products with both halves' words of a code."""
        found = rows @ self.words[code, :, : rows.shape[1]].T
        return found[:, : self.directions], found[:, self.directions :]

    @cached_property
    def bound(self) -> float:
        """The inner product that a filter asks for, so that ``recall`` of the pairs at
        the threshold share a filter: a quantile, over random such pairs, of the best
        filter's smaller product. Only the best words of either half are tried for a
        pair, which can but lower the bound."""
        x = unit(self.rng.normal(size=(SAMPLE_PAIRS, self.width)))
        y = self.rng.normal(size=x.shape)
        y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = self.threshold * x + math.sqrt(max(0.0, 1 - self.threshold**2)) * y
        best = np.full(SAMPLE_PAIRS, -np.inf)
        take = np.take_along_axis
        for code in range(self.codes):
            for at in range(0, SAMPLE_PAIRS, 500):
                x1, x2 = self.scores(x[at : at + 500], code)
                y1, y2 = self.scores(y[at : at + 500], code)
                i = np.argsort(-(x1 + y1), axis=1)[:, :BEST_WORDS]
                j = np.argsort(-(x2 + y2), axis=1)[:, :BEST_WORDS]
                first = take(x1, i, 1)[:, :, None] + take(x2, j, 1)[:, None, :]
                second = take(y1, i, 1)[:, :, None] + take(y2, j, 1)[:, None, :]
                shared = np.minimum(first, second).max(axis=(1, 2))
                best[at : at + 500] = np.maximum(best[at : at + 500], shared)
        return float(np.quantile(best, 1 - self.recall, method="lower"))

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that exceeds the bound, by rows and filters."""
        owners, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (1 << 20) // self.directions)
        for code in range(self.codes):
            for at in range(0, len(rows), step):
                first, second = self.scores(rows[at : at + step], code)
                order = np.argsort(-second, axis=1, kind="stable")
                second = np.take_along_axis(second, order, axis=1)
                v, i = np.nonzero(first + second[:, :1] >= self.bound)
                for lo in range(0, len(v), step):
                    vv, ii = v[lo : lo + step], i[lo : lo + step]
                    exceeds = first[vv, ii][:, None] + second[vv] >= self.bound
                    k, rank = np.nonzero(exceeds)  # a prefix of the sorted list
                    owners.append(at + vv[k])
                    filters.append((code * self.directions + ii[k]) * self.directions + order[vv[k], rank])
        owner, found = np.concatenate(owners), np.concatenate(filters)
        order = np.lexsort((found, owner))
        return owner[order], found[order]


class Codes(dict):
    """Product codes by dimension, made when first asked for."""

    def __init__(self, directions: int, threshold: float, recall: float):
        self.arguments = directions, threshold, recall

    def __missing__(self, dimensions: int) -> ProductCode:
        self[dimensions] = code = ProductCode(dimensions, *self.arguments)
        return code


def usable(vec: Column) -> Column:
    """Not null or empty, no null, NaN or infinite component, and not all zeros."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _decoder(codes_of: tuple):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*codes_of)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    owner, found = codes[int(d)].decode(unit(_matrix(some.column(2))))
                    offsets = np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["uid", "filters"])

    return decode


def _cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least that cosine. Close calls of the
    matrix product are settled by the plain formula, so no pair's answer depends on
    the block it is met in."""
    a, b = scaled(a), scaled(b)
    near = unit(a) @ unit(b).T
    linked = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-9)):
        x, y = a[i], b[j]
        norms = math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))
        linked[i, j] = math.fsum(x * y) / norms >= threshold
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, each row's smallest connected row."""
    root = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if root[seed] < 0:
            reached = np.array([seed])
            while len(reached):
                root[reached] = seed
                reached = np.flatnonzero(linked[reached].any(axis=0) & (root < 0))
    return root


def cell_links(
    vectors: np.ndarray, own: np.ndarray, copies: np.ndarray, code: ProductCode, bucket: int
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the vectors of one cell of a filter: how many vectors, copies
    counted, each is linked to by pairs whose first common filter this is, and the
    first vector it is connected to by such pairs."""
    linked = _cosines(vectors, vectors, code.threshold)
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    np.fill_diagonal(linked, False)
    some = np.flatnonzero(linked.any(axis=0))
    links, root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    if len(some):
        linked = linked[np.ix_(some, some)]
        owner, found = code.decode(unit(vectors[some]))
        earlier = found < bucket
        names, column = np.unique(found[earlier], return_inverse=True)
        member = np.zeros((len(some), len(names)), dtype=np.float32)
        member[owner[earlier], column] = 1
        linked &= member @ member.T == 0
        links[some] = linked @ copies[some]
        root[some] = some[_roots(linked)]
    return links, root


def _linker(codes_of: tuple):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*codes_of)
        keys = ["dims", "bucket", "__i", "__j"]
        for table in whole_groups(batches, keys, 1):
            cell = np.stack([table.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, table.num_rows]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                uid, own, copies = (part.column(c).to_numpy() for c in ("uid", "__own", "copies"))
                code = codes[int(cell[0, lo])]
                links, root = cell_links(_matrix(part.column("vec")), own, copies, code, int(cell[1, lo]))
                some = np.flatnonzero(links)
                if len(some):
                    columns = [pa.array(x[some]) for x in (uid, links, uid[root])]
                    yield pa.RecordBatch.from_arrays(columns, names=["uid", "links", "root"])

    return link


def linked_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    bucket_vectors: int = BUCKET_VECTORS,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``: how many
    other rows have a cosine of at least ``threshold`` (above 0) to it, and the smallest
    id of the rows it is connected to by such links, itself included.

    1. Equal vectors become one with a count, so copies cost nothing further.
    2. Each distinct vector is decoded to its filters. The number of directions grows
       with the number of vectors, up to ``MOST_DIRECTIONS`` a half, so that filters stay
       small; the bound follows
       from ``recall`` by trial on random pairs, not from the data.
    3. Vectors of a filter are compared exactly, in double precision. A filter
       with more than ``block_vectors`` is cut into blocks that meet pairwise in
       cells, so a dense clump of vectors is many bounded tasks. A pair counts only
       in the first filter it has in common. A cell returns a count and one link for
       a vector, never its pairs.
    4. Components of these links give the ids.

    No link is below the threshold; a pair at it is found with probability ``recall``,
    a nearer one more surely. Vectors are shuffled once for each of their filters
    (some twenty; forty among a thousand million).

    Vectors that are null, empty, all zeros or hold null, NaN or infinite components
    link with nothing, nor do vectors of different lengths. Every row is a vector of its own,
    also where ids repeat; a null id never names a component, so rows connected
    to no id have a null one. ``kept`` says whether the id is the component's (null is
    null). Other columns are ignored; an empty table gives an empty result.
    """
    vec = F.col(vector_col)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.when(usable(vec), vec).alias("vec")
    ).withColumns({"a": F.xxhash64(F.lit(1), "vec"), "b": F.xxhash64(F.lit(2), "vec")})
    whole = rows.where("vec is not null")
    distinct = whole.groupBy("a", "b").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")
    )
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")
    codes_of = (directions_for(distinct.count(), bucket_vectors), threshold, recall)

    sized = distinct.select("uid", F.size("vec").alias("dims"), "vec")
    decoded = written(sized.mapInArrow(_decoder(codes_of), "uid long, filters array<int>"), "filters")
    placed = decoded.join(distinct.select("uid", "copies", F.size("vec").alias("dims"), "vec"), "uid")
    placed = placed.withColumn("bucket", F.explode("filters")).drop("filters")
    cells = dealt_in_blocks(placed, ["dims", "bucket"], F.xxhash64("uid"), block_vectors)
    keys = ["dims", "bucket", "__i", "__j"]
    cells = cells.select(*keys, "__own", "uid", "copies", "vec").repartition(*keys).sortWithinPartitions(*keys)
    found = written(cells.mapInArrow(_linker(codes_of), "uid long, links long, root long"), "vector-links")

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = connected_components(found, "uid", "root").withColumnRenamed("id", "uid")
    named = distinct.select("uid", "a", "b", "first", "copies").join(joined, "uid", "left").withColumn(
        "component", F.coalesce("component", "uid")
    )
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").join(links, "uid", "left").select(
        "a", "b", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = rows.where("vec is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = whole.select("vec_id", "a", "b").join(named, ["a", "b"]).select("vec_id", "n_links", "component_id")
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
