"""Principal components of wide tables by randomised block power iteration: nothing of
size ``columns x columns`` is made anywhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vectors beyond k that the block holds; they speed up convergence.
EXTRA_VECTORS = 10
# The iteration ends when no wanted variance changes by more than this share, or no row's
# worth of it is left to turn; or after so many products.
TOLERANCE = 1e-10
MOST_PRODUCTS = 60
# Values of a block of rows in a task (64 MB of doubles).
BLOCK_VALUES = 8_000_000


def block_pca(df: DataFrame, values: Sequence[Column], k: int, out: str, seed: int = 17) -> DataFrame:
    """``df`` with the scores on the first ``k`` principal components as array column ``out``.

    A block of ``k + EXTRA_VECTORS`` random directions is multiplied by the centred table
    and its transpose, made orthonormal, and so on; the best directions within the block
    (Rayleigh-Ritz) are the components once their variances stand still. A
    product is one scan: each task multiplies its rows, a block at a time, and returns a
    row for each column, which a grouped sum adds up. The driver holds a few matrices of
    ``columns x (k + EXTRA_VECTORS)``; so does a task, beside a block of rows.

    Components whose variances are nearly equal are found as a subspace, not one by one.
    Rows with a null or NaN are left out by the tasks, and their scores are null, as all are
    without a complete row. The scores are computed by batches with the same
    matrices. Batches are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    d = len(values)
    row = F.array(*values)  # whole tables of wide rows: no expression but the array itself
    whole = df.select(row.alias("x"))
    sums = _summed(whole, _column_sums(d), 2, d)  # per column: sum, rows
    n = sums[0, 1]
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    means = sums[:, 0] / n
    wide = min(d, k + EXTRA_VECTORS)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    before = None
    for _ in range(MOST_PRODUCTS):
        product = _summed(whole, _products(means, block), wide, d)
        small = block.T @ product
        variances, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-variances)[:k]
        found, variances = block @ turn[:, order], variances[order]
        scale = max(abs(variances[0]), np.finfo(float).tiny)
        still = before is not None and np.all(np.abs(variances - before) <= TOLERANCE * scale)
        if still or wide == d:  # a block of full width holds the exact answer
            break
        before = variances
        block = np.linalg.qr(product)[0]
    for j in range(k):
        if found[np.argmax(np.abs(found[:, j])), j] < 0:
            found[:, j] = -found[:, j]

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_scores_of(np.asarray(x, dtype=float), means, found) for x in batch], dtype=object)

    return df.withColumn(out, scores(row))


def _scores_of(x: np.ndarray, means: np.ndarray, found: np.ndarray) -> list:
    if np.isnan(x).any():
        return [None] * found.shape[1]
    return ((x - means) @ found).tolist()


def _summed(rows: DataFrame, of_task, width: int, d: int) -> np.ndarray:
    """The sum over all tasks of the ``d x width`` matrices that ``of_task`` returns."""
    names = [f"c{j}" for j in range(width)]
    schema = ", ".join(["i int", *[f"{c} double" for c in names]])
    parts = rows.mapInPandas(of_task, schema)
    total = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row for each column
    matrix = np.zeros((d, width))
    if len(total):
        matrix[total["i"].to_numpy()] = total[names].to_numpy()
    return matrix


def _matrix_rows(matrix: np.ndarray) -> pd.DataFrame:
    made = pd.DataFrame(matrix, columns=[f"c{j}" for j in range(matrix.shape[1])])
    made.insert(0, "i", np.arange(len(matrix), dtype=np.int32))
    return made


def _blocks(batches: Iterator[pd.DataFrame], d: int) -> Iterator[np.ndarray]:
    """The complete rows of a task as matrices of bounded size."""
    step = max(1, BLOCK_VALUES // d)
    for batch in batches:
        for at in range(0, len(batch), step):
            x = np.stack(batch["x"].iloc[at:at + step].to_numpy()).astype(float)
            yield x[~np.isnan(x).any(axis=1)]


def _column_sums(d: int):
    def of_task(batches):
        sums, n = np.zeros(d), 0
        for x in _blocks(batches, d):
            sums += x.sum(axis=0)
            n += len(x)
        if n:
            yield _matrix_rows(np.stack([sums, np.full(d, float(n))], axis=1))

    return of_task


def _products(means: np.ndarray, block: np.ndarray):
    def of_task(batches):
        total, any_row = np.zeros(block.shape), False
        for x in _blocks(batches, len(means)):
            x = x - means
            total += x.T @ (x @ block)
            any_row = any_row or len(x) > 0
        if any_row:
            yield _matrix_rows(total)

    return of_task
