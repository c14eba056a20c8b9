"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

A text's features are its hashed n-grams inside words, each with the square root of
how often it occurs in a hundred words. The log ratio of an n-gram's share among toxic
and other texts scales it; a logistic regression on the scaled features is fitted on
labelled texts. N-grams whose ratio is not clearly other than zero have weight zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.common import one_text, written
from blockpipe.llm.ngrams import PIECE_CHARS, counted, ngrams, pieces
from blockpipe.llm.words import normal_words, text_groups

BITS = 20
SAMPLE_TEXTS = 6_000  # labelled texts of each label that a fit uses at most
SMOOTHING = 0.5
MIN_Z = 3.0
PENALTY = 1e-4
STEPS = 600
SPARE_WORDS = 20  # so that a word in a very short text doesn't count for much more
THRESHOLD = 0.7


def _features(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), ordered by text. Long texts are counted in pieces."""
    texts = part.column(column).to_pylist()
    owner, bucket, times, cut = [], [], [], False
    for text, group in pieces(texts):
        o, b, t = counted(*ngrams(group, BITS), BITS)
        cut = cut or (len(owner) > 0 and len(owner[-1]) > 0 and owner[-1][-1] == text[0])
        owner.append(text[o])
        bucket.append(b)
        times.append(t)
    owner, bucket, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, bucket, times))
    if cut:  # sum up the pieces of a text
        keys, place = np.unique((owner << BITS) | bucket, return_inverse=True)
        times = np.bincount(place, times).astype(np.int64)
        owner, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
    words = np.array([t.count(" ") for t in texts], dtype=np.float64)
    return owner, bucket, np.sqrt(100 * times / (words[owner] + SPARE_WORDS))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each n-gram, how many toxic and how many other texts of a task have it."""
    toxic, other = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for lo, hi in text_groups(batch, 0, PIECE_CHARS):
            part = batch.slice(lo, hi - lo)
            owner, bucket, _ = _features(part, 0)
            label = np.asarray(part.column(1).to_pylist(), dtype=np.int64)
            np.add.at(toxic, bucket[label[owner] == 1], 1)
            np.add.at(other, bucket[label[owner] == 0], 1)
    seen = np.flatnonzero(toxic + other)
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(toxic[seen]), pa.array(other[seen])], names=["bucket", "toxic", "other"]
    )


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """log of the smoothed share among toxic texts over that among others; 0 where
    it is within ``MIN_Z`` standard errors of 0."""
    p, q = toxic + SMOOTHING, other + SMOOTHING
    ratio = np.log(p / (n_toxic + 2 * SMOOTHING)) - np.log(q / (n_other + 2 * SMOOTHING))
    clear = np.abs(ratio) >= MIN_Z * np.sqrt(1 / p + 1 / q)
    return np.where(clear, ratio, 0.0)


def fit_logistic(
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, scale: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights of the features scaled by ``scale``, and an intercept: full-batch
    gradient descent with momentum, squared weights penalised, both labels of equal
    weight. A part has some texts' number of features, all their features and values;
    the texts of all parts are in the order of ``labels``. Beside the parts, memory
    is that of the largest part."""
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    ends = np.cumsum([0] + [len(sizes) for sizes, _, _ in parts])

    def owners(k: int) -> np.ndarray:
        return np.repeat(np.arange(len(parts[k][0])), parts[k][0])

    def by_text(k: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(owners(k), values, minlength=len(parts[k][0]))

    norms = [by_text(k, (value * scale[feature]) ** 2) for k, (_, feature, value) in enumerate(parts)]
    norm = np.quantile(np.concatenate(norms), 0.99)
    rate = 4.0 / (norm + 1)
    w, b, vw, vb = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    for _ in range(STEPS):
        scaled, slope, total = w * scale, np.zeros(len(scale)), 0.0
        for k, (_, feature, value) in enumerate(parts):
            texts = slice(ends[k], ends[k + 1])
            margin = by_text(k, value * scaled[feature]) + b
            error = weight[texts] * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[texts])
            slope += np.bincount(feature, value * error[owners(k)], minlength=len(scale))
            total += error.sum()
        vw = 0.9 * vw - rate * (slope * scale + PENALTY * w)
        vb = 0.9 * vb - total
        w, b = w + vw, b + vb
    return w * scale, b


class ToxicityModel:
    """``weights`` by n-gram bucket and ``intercept``; size bound by ``BITS``."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, texts: pa.RecordBatch, column: int) -> np.ndarray:
        owner, bucket, value = _features(texts, column)
        margin = np.bincount(owner, self.weights[bucket] * value, minlength=texts.num_rows) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE_TEXTS,
) -> ToxicityModel:
    """Train on the labelled documents among ``docs``: all of them, up to ``sample``
    of each label, then those with the smallest hash of their id. Only the chosen
    ids and labels (bound by ``sample``) are broadcast; n-grams are counted where the
    texts are, and the driver gets one count for each of at most ``2 ** BITS``
    n-grams and the chosen texts' clear features.

    Of several labels for an id the largest holds, of several rows of an id the
    text of the smallest digest; null labels and ids are ignored, and ids must be
    numbers; a null text counts as empty. With no labelled text of either label, all
    scores are 0.5 or follow the one label's share. Of few labelled texts hardly any
    n-gram's ratio is clear (``MIN_Z``), so such a model tells little.

    A chosen text is worked off in pieces; the driver gets at most 8 bytes for each of
    its clear n-grams, 8 MB a text at most (``2 ** BITS`` of them), some kilobytes as
    a rule.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    labelled = known.join(ids, "id", "left_semi")
    chosen = None
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    spark = docs.sparkSession
    rows = chosen.toPandas()  # at most 2 * sample ids
    chosen = spark.createDataFrame([(int(i), int(y)) for i, y in zip(rows["id"], rows["label"])], "id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    texts = one_text(texts.join(F.broadcast(chosen), "id"), "t", "id", "label")
    texts = written(texts.select(normal_words(F.col("t")).alias("w"), "label"), "labelled-texts")

    counts = texts.select("w", "label").mapInArrow(_counts, "bucket long, toxic long, other long")
    total = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas()
    toxic, other = np.zeros(1 << BITS), np.zeros(1 << BITS)
    toxic[total["bucket"]], other[total["bucket"]] = total["toxic"], total["other"]
    n_toxic, n_other = int((rows["label"] == 1).sum()), int((rows["label"] == 0).sum())
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not n_toxic or not n_other:
        return ToxicityModel(weights, 0.0 if n_toxic == n_other else (4.0 if n_toxic else -4.0))
    ratio = log_count_ratios(toxic, other, n_toxic, n_other)
    clear = np.flatnonzero(ratio)
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[clear] = np.arange(len(clear))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_groups(batch, 0, PIECE_CHARS):
                part = batch.slice(lo, hi - lo)
                owner, bucket, value = _features(part, 0)
                kept = number[bucket] >= 0
                owner, index, value = owner[kept], number[bucket[kept]], value[kept]
                ends = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (index, value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*lists, part.column(1)], names=["f", "v", "label"])

    table = texts.select("w", "label").mapInArrow(sparse, "f array<int>, v array<float>, label int").toArrow()
    # a batch's features stay in Arrow's buffers, 8 bytes each
    parts = [
        (pc.list_value_length(x.column(0)).to_numpy(), x.column(0).flatten().to_numpy(), x.column(1).flatten().to_numpy())
        for x in table.to_batches()
        if x.num_rows
    ]
    w, b = fit_logistic(parts, table.column(2).to_numpy().astype(np.float64), ratio[clear])
    weights[clear] = w
    return ToxicityModel(weights, float(b))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` as (its columns, ``toxicity``), the score of the whole text from 0 to
    1. Null and empty texts and texts without words get the score of no features.
    Repeated rows are scored alike; a column named ``toxicity`` is replaced; an empty
    table gives an empty result. No shuffle; the model is of fixed size."""
    broadcast = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ToxicityModel(*broadcast.value)
        for words in batches:
            batch = pa.RecordBatch.from_arrays([words], names=["w"])
            parts = [model.score(batch.slice(lo, hi - lo), 0) for lo, hi in text_groups(batch, 0, PIECE_CHARS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn("toxicity", score(normal_words(F.col(text_col))))
