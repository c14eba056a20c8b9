"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt over shards of bounded size. A shard's graph grows in
batches: greedy searches from the shard's centre propose neighbours for new points,
and pruning by relaxed distance keeps a few diverse edges (a candidate goes if a kept
neighbour is nearer to it by a factor). Queries run a beam search on every shard, and
the shards' nearest are merged with exact distances.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockpipe.llm.common import written

SHARD_VECTORS = 8192
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 112
RELAX = 1.2
WIDTH = 4
BATCH = 512
QUERY_BLOCK = 1024


def _squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows by columns by dimension) to one other each row."""
    diff = points - others[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def beam_search(
    vectors: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, width: int = WIDTH
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` nearest points met by greedy searches
    for many queries in step, nearest first; -1 where there are fewer. In each step a
    query visits the neighbours of its ``width`` nearest unvisited points."""
    n, m = len(vectors), len(queries)
    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.zeros((m, beam), dtype=bool)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True  # the place of missing neighbours
    first = np.arange(n) if n <= beam else starts  # a small shard is searched whole
    ids[:, : len(first)] = first
    dist[:, : len(first)] = _squared(np.broadcast_to(vectors[first], (m, len(first), vectors.shape[1])), queries)
    seen[:, first] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    active = np.arange(m)
    while len(active):
        todo = ~done[active] & (ids[active] >= 0)
        rank = np.cumsum(todo, axis=1)
        pick = todo & (rank <= width)
        some = pick.any(axis=1)
        active, pick = active[some], pick[some]
        if not len(active):
            break
        done[active] |= pick
        row, col = np.nonzero(pick)
        reach = np.full((len(active), width, graph.shape[1]), n, dtype=np.int64)
        reach[row, np.cumsum(pick, axis=1)[row, col] - 1] = graph[ids[active][row, col]]
        reach = reach.reshape(len(active), -1)
        reach.sort(axis=1)
        reach[:, 1:][reach[:, 1:] == reach[:, :-1]] = n
        who = active[:, None]
        new = ~seen[who, reach]
        seen[who, reach] = True
        most = int(new.sum(axis=1).max(initial=0))
        if not most:
            continue
        left = np.argsort(~new, axis=1, kind="stable")[:, :most]
        reach = np.where(np.take_along_axis(new, left, 1), np.take_along_axis(reach, left, 1), n)
        far = _squared(vectors[np.minimum(reach, n - 1)], queries[active])
        far[reach == n] = np.inf
        both = np.concatenate((dist[active], far), axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(both, order, 1)
        ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(reach == n, -1, reach)), axis=1), order, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], np.zeros_like(reach, dtype=bool)), axis=1), order, 1)
    return ids, dist


def robust_prune(
    vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float
) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1: none): the nearest is
    kept, candidates that it is nearer to than the point is, by the factor ``relax``,
    go, and so on with the rest. -1 fills up."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    near = vectors[np.maximum(candidates, 0)]
    dist = _squared(near, vectors[points])
    dist[candidates < 0] = np.inf
    kept = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for slot in range(degree):
        best = dist.argmin(axis=1)
        live = np.isfinite(dist[rows, best])
        if not live.any():
            break
        kept[live, slot] = candidates[live, best[live]]
        between = _squared(near, near[rows, best])
        dist[between * np.float32(relax * relax) <= dist] = np.inf
        dist[rows, best] = np.inf
    return kept


def build_graph(
    vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, batch: int = BATCH
) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each point, -1 filling up; the starts of searches: the point
    nearest to the centre and some at random, so that a dense clump, which a search
    hardly leaves, is not the only way in)."""
    n = len(vectors)
    centre = int(_squared(vectors[None, :, :], vectors.mean(axis=0, keepdims=True))[0].argmin())
    graph = np.full((n + 1, degree), -1, dtype=np.int64)
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = np.concatenate(([centre], order[order != centre]))
    starts = order[: min(n, beam // 2)]
    at = len(starts)
    if at > 1:
        graph[starts] = robust_prune(vectors, starts, np.broadcast_to(starts, (at, at)), degree, relax)
    while at < n:
        points = order[at : at + min(batch, at)]  # no more new points than there are old ones
        links = np.where(graph < 0, n, graph)
        met, _ = beam_search(vectors, links, starts, vectors[points], beam)
        graph[points] = robust_prune(vectors, points, met, degree, relax)
        # edges back; lists that get too long are pruned again
        source, target = np.repeat(points, degree), graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(many.max(initial=0))), -1, dtype=np.int64)
        wide[np.repeat(np.arange(len(nodes)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        for lo in range(0, len(nodes), 256):
            own, more = nodes[lo : lo + 256], wide[lo : lo + 256]
            more = more[:, : int(many[lo : lo + 256].max())]
            merged = np.concatenate((graph[own], more), axis=1)
            fits = (merged >= 0).sum(axis=1) <= degree
            packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)[:, :degree]
            graph[own[fits]] = packed[fits]
            if not fits.all():
                graph[own[~fits]] = robust_prune(vectors, own[~fits], merged[~fits], degree, relax)
        at += len(points)
    return graph[:n], starts


# --- the operator --------------------------------------------------------------------------


def valid_vector(v: Column) -> Column:
    """Not null, not empty, not all zero, no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


INDEX = "dims int, shard int, starts array<long>, vectors binary, graph binary, members array<array<long>>"


def build_index(
    base: DataFrame, id_col: str, vector_col: str, keep_ids: int,
    shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX,
) -> DataFrame:
    """One row for each shard: its distinct vectors, their graph and, for each vector,
    the ``keep_ids`` smallest ids that have it. Of a vector that many rows share only so
    many rows are ever shuffled from a task."""
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & valid_vector(F.col("v"))).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= keep_ids)
    distinct = written(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "distinct-vectors")
    shards = max(1, math.ceil(distinct.count() / shard_vectors))
    dealt = distinct.withColumn("dims", F.size("v")).withColumn(
        "shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [np.asarray(x).tolist() for x in pdf["ids"]]
        by = sorted(range(len(ids)), key=lambda i: ids[i])
        vectors = np.stack([np.asarray(pdf["v"].iloc[i], dtype=np.float64) for i in by])
        graph, starts = build_graph(vectors.astype(np.float32), degree, beam, relax)
        row = (
            int(pdf["dims"].iloc[0]), int(pdf["shard"].iloc[0]), starts.tolist(),
            vectors.tobytes(), graph.astype(np.int32).tobytes(), [ids[i] for i in by],
        )
        return pd.DataFrame([row], columns=["dims", "shard", "starts", "vectors", "graph", "members"])

    return written(dealt.groupBy("dims", "shard").applyInPandas(build, INDEX), "ann-index")


def search(
    queries: DataFrame, index: DataFrame, id_col: str, vector_col: str, k: int,
    beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest found by beam
    searches on every shard. A task searches one shard for one block of queries."""
    rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
    rows = rows.where(F.col("query_id").isNotNull() & valid_vector(F.col("q"))).distinct()
    blocks = max(1, math.ceil(rows.count() / query_block))
    shards = index.select(F.col("dims").alias("q_dims"), F.col("shard").alias("q_shard"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = rows.withColumn("q_dims", F.size("q")).withColumn("q_block", block).join(shards, "q_dims")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(ask):
            row = shard.iloc[0]
            vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, int(row["dims"]))
            graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(len(vectors), -1).astype(np.int64)
            graph = np.where(graph < 0, len(vectors), graph)
            wanted = np.stack([np.asarray(q, dtype=np.float64) for q in ask["q"]])
            near = vectors.astype(np.float32)
            wide = max(beam, 2 * (k + 1))
            ids, _ = beam_search(near, graph, np.asarray(row["starts"]), wanted.astype(np.float32), wide)
            for query_id, q, found in zip(ask["query_id"], wanted, ids):
                found = found[found >= 0]
                exact = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
                pairs = [
                    (float(d), int(i)) for d, j in zip(exact, found) for i in row["members"][j] if i != query_id
                ]
                out += [(query_id, i, d) for d, i in sorted(pairs)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    asked = asked.groupBy("q_dims", "q_shard", "q_block")
    found = held.groupBy("dims", "shard", "block").cogroup(asked).applyInPandas(
        find, "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX,
    search_beam: int = SEARCH_BEAM,
) -> DataFrame:
    """The ``k`` rows of ``base`` nearest to each query by Euclidean distance in double
    precision, the query's own id left out: query_id, rank (from 1), vec_id, score,
    nearest first, ties to the smaller id; all candidates if there are fewer.

    Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a
    result can show of them; so copies neither fill a shard nor hide each other. Shards
    have about ``shard_vectors`` distinct vectors whatever the total.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part on either side. Repeated rows count once; of several
    vectors of one id the nearest counts. Vectors of another length are no candidates.
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    index = build_index(base, id_col, vector_col, k + 1, shard_vectors, degree, beam, relax)
    return search(queries, index, id_col, vector_col, k, search_beam)
