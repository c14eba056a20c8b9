"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear
softmax gives the languages' probabilities. Both layers are trained together by
stochastic gradient descent in numpy. A temperature fitted on texts set aside
calibrates the probabilities, and texts whose best one is smaller than nearly all of
rightly told texts of their length have are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockpipe.llm.common import one_text, written
from blockpipe.llm.ngrams import PIECE_CHARS, ngrams, pieces
from blockpipe.llm.words import normal_words, text_groups
from blockpipe.plans.sizing import broadcast_if_small

BITS = 17
DIMENSIONS = 16
SAMPLE_TEXTS = 1_200  # texts of each language that a fit uses at most
SENT_CHARS = 20_000  # a longer text reaches the driver as its n-grams' shares
EPOCHS = 4
RATE = 40.0
SET_ASIDE = 5  # one in so many texts calibrates
REJECT_SHARE = 0.002  # all but so many of the rightly told texts of a length that are set aside
SLACK = 0.5  # have log-odds above some value; texts with less than half of that are rejected
LENGTHS = 32  # classes of length: a text of n n-grams is in the class of n + 1's bits
SNIPPET_WORDS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64)
UNKNOWN = "und"


class LanguageModel:
    """``logits`` (bucket by language; embeddings times output layer), intercepts,
    temperature and, by length class, the least accepted probability. Size bound by
    ``BITS``."""

    def __init__(self, languages, logits, intercepts, temperature=1.0, least=None):
        self.languages, self.logits, self.intercepts = languages, logits, intercepts
        self.temperature = temperature
        self.least = np.zeros(LENGTHS) if least is None else least

    def values(self) -> tuple:
        return self.languages, self.logits, self.intercepts, self.temperature, self.least

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, n-grams) of each text; long texts are added up in pieces."""
        sums, many = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for text, group in pieces(texts):
            owner, bucket = ngrams(group, BITS)
            np.add.at(many, text, np.bincount(owner, minlength=len(group)))
            parts = [np.bincount(owner, self.logits[bucket, k], len(group)) for k in range(len(self.languages))]
            np.add.at(sums, text, np.stack(parts, axis=1))
        return sums / np.maximum(many, 1)[:, None] + self.intercepts, many

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether the best is too small) of each text."""
        margins, many = self.margins(texts)
        p = _softmax(margins / self.temperature)
        return p, p.max(axis=1) < self.least[length_class(many)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def length_class(many: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(many + 1).astype(np.int64), LENGTHS - 1)


class Example:
    """A labelled text as training takes it: how often it has each of its n-grams, and a
    few words of it for each epoch and for each of ``SNIPPET_WORDS``, drawn by ``seed``.
    The driver holds all examples at once, so numbers take as few bytes as they need."""

    def __init__(self, text: str, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed % (1 << 63)))
        words = text.split()

        def drawn(n: int) -> str:
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            return " ".join(words[at : at + n]) + " "

        self.views = [drawn(int(rng.integers(1, 13))) for _ in range(EPOCHS)]
        self.snippets = [drawn(n) for n in SNIPPET_WORDS if n <= len(words)]
        counts: dict = {}
        many = 0
        for _, group in pieces([text]):
            _, bucket = ngrams(group, BITS)
            many += len(bucket)
            for b, c in zip(*(x.tolist() for x in np.unique(bucket, return_counts=True))):
                counts[b] = counts.get(b, 0) + c
        self.buckets = np.array(sorted(counts), dtype=np.int32)
        self.counts = _small(np.array([counts[b] for b in sorted(counts)], dtype=np.int64))
        self.many = many

    @property
    def shares(self) -> np.ndarray:
        return self.counts.astype(np.float64) / max(self.many, 1)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def _shares(view: str) -> tuple[np.ndarray, np.ndarray]:
    _, bucket = ngrams([view], BITS)
    buckets, counts = np.unique(bucket, return_counts=True)
    return buckets, counts / max(1, len(bucket))


def train(examples: list[Example], labels: list[str], seed: int = 1) -> LanguageModel:
    """Fit on normalised texts. Each is seen whole and as a few of its words in every
    epoch, so that short texts are learned too."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    aside = np.arange(len(examples)) % SET_ASIDE == 0
    if len(examples) < 4 * SET_ASIDE:
        aside[:] = False
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    intercepts = np.zeros(len(languages))
    own = np.flatnonzero(~aside)
    share = np.bincount(y[own], minlength=len(languages))
    weight = len(own) / (np.maximum(share, 1) * len(languages))
    steps, done = EPOCHS * len(own) * 2, 0
    for epoch in range(EPOCHS):
        rng.shuffle(own)
        for i in own:
            whole = examples[i].buckets, examples[i].shares
            for buckets, part in (whole, _shares(examples[i].views[epoch])):
                rate = RATE * (1 - done / steps)
                done += 1
                if not len(buckets):
                    continue
                part = part.astype(np.float32)
                mean = part @ table[buckets]
                error = _softmax(mean @ out + intercepts)
                error[y[i]] -= 1
                error *= weight[y[i]]
                back = out @ error
                out -= 0.005 * rate * np.outer(mean, error)
                intercepts -= 0.0005 * rate * error
                table[buckets] -= (rate * part)[:, None] * back.astype(np.float32)[None, :]
    model = LanguageModel(languages, (table @ out).astype(np.float32), intercepts)
    held = np.flatnonzero(aside)
    return calibrated(model, [examples[i] for i in held], y[held]) if len(held) else model


def calibrated(model: LanguageModel, examples: list[Example], y: np.ndarray) -> LanguageModel:
    """With the temperature of the least negative log-likelihood, and for each length
    class a rejection bound: half (``SLACK``) of the log-odds that all but
    ``REJECT_SHARE`` of the right predictions reach, since that value is that of a
    few texts only. As in Platt's scaling, a label counts as certain only as far as so many
    texts can show, so that texts which are all told rightly don't make every score 1.

    Bounds are taken from the texts and from a few of their words at a time. A class
    gets no larger bound than a longer one, and one without texts the next shorter's,
    so that rare lengths are not rejected for want of examples."""
    margins = np.stack([x.shares @ model.logits[x.buckets] + model.intercepts for x in examples])
    grid = np.geomspace(0.05, 20, 121)
    others = max(1, margins.shape[1] - 1)
    doubt = 1 / (len(y) + 2) if margins.shape[1] > 1 else 0.0
    target = np.full(margins.shape, doubt / others)
    target[np.arange(len(y)), y] = 1 - doubt
    loss = [-(target * np.log(_softmax(margins / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    snippets = [(s, label) for x, label in zip(examples, y) for s in x.snippets]
    some, many = model.margins([s for s, _ in snippets])
    best = _softmax(np.concatenate((margins, some)) / temperature)
    wanted = np.concatenate((y, np.array([label for _, label in snippets], dtype=np.int64)))
    lengths = length_class(np.concatenate((np.array([x.many for x in examples], dtype=np.int64), many)))
    least = np.zeros(LENGTHS)
    for k in range(LENGTHS):
        here = best[(lengths == k) & (best.argmax(axis=1) == wanted)].max(axis=1, initial=0)
        if len(here):
            p = min(np.sort(here)[int(REJECT_SHARE * len(here))], 1 - 1e-15)
            least[k] = 1 / (1 + (1 / p - 1) ** SLACK)
        elif k:
            least[k] = least[k - 1]
    least = np.minimum.accumulate(least[::-1])[::-1]
    return LanguageModel(model.languages, model.logits, model.intercepts, temperature, least)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts as pickled examples, others as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            text = row.column(2)[0].as_py()
            packed = None
            if len(text) > SENT_CHARS:
                x = Example(text, row.column(0)[0].as_py())
                arrays = [pa.array([v], t) for v, t in zip(
                    (x.buckets, x.counts, x.views, x.snippets, x.many), [f.type for f in _EXAMPLE]
                )]
                packed, text = pa.StructArray.from_arrays(arrays, fields=list(_EXAMPLE)), None
            packed = pa.nulls(1, _EXAMPLE) if packed is None else packed
            yield pa.RecordBatch.from_arrays(
                [row.column(0), row.column(1), pa.array([text], pa.string()), packed], names=["h", "lang", "w", "x"]
            )


_EXAMPLE = pa.struct(
    [
        ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
        ("views", pa.list_(pa.string())), ("snippets", pa.list_(pa.string())), ("many", pa.int64()),
    ]
)
_SENT = (
    "h long, lang string, w string, "
    "x struct<buckets: array<int>, counts: array<long>, views: array<string>, snippets: array<string>, many: long>"
)


def _example(h: int, text: str | None, packed: dict | None) -> Example:
    if packed is None:
        return Example(text, h)
    x = Example.__new__(Example)
    x.buckets, x.counts = np.array(packed["buckets"], np.int32), _small(np.array(packed["counts"], np.int64))
    x.views, x.snippets, x.many = packed["views"], packed["snippets"], packed["many"]
    return x


def _fields(packed: pa.StructScalar) -> dict | None:
    """An example's fields, numbers straight from Arrow's buffers, as there may be many."""
    if not packed.is_valid:
        return None
    return {k: v.values.to_numpy() if k in ("buckets", "counts") else v.as_py() for k, v in packed.items()}


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE_TEXTS,
) -> LanguageModel:
    """Train on ``docs`` with a language and a letter in the text: of each language up
    to ``sample`` texts of any length, those with the smallest hash of their id (a hash's
    30 bits). Of several rows of an id in a language the text of the smallest digest
    counts, and only that; ids must be numbers. Without any such text the model knows
    no language and rejects everything.

    The driver gets these texts and no others; one longer than ``SENT_CHARS`` as what
    training takes of it, the counts of its n-grams (12 bytes each of at most
    ``2 ** BITS``, then held in 5 as a rule), which the task counts piece by piece. The
    model is the same either way."""
    spark = docs.sparkSession
    text = F.col(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(text.rlike(r"\p{L}"))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), text.alias("t"))
    # a hash of the id thins each language to about the sample's size before it is ranked
    ids = written(known.select("id", "lang").distinct(), "labelled-ids").withColumn("h", F.xxhash64("id"))
    sizes, _ = broadcast_if_small(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    thinned = ids.join(sizes, "lang").where(share < F.lit(2.0 * sample) / F.col("size"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "id")
    ids = thinned.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
    rows = ids.select("id", "lang").toPandas()
    if not len(rows):
        return train([], [])
    chosen = spark.createDataFrame([(int(i), str(x)) for i, x in zip(rows["id"], rows["lang"])], "id long, lang string")
    picked = one_text(known.join(F.broadcast(chosen), ["id", "lang"]), "t", "id", "lang")
    picked = picked.select(F.xxhash64("id").alias("h"), "lang", normal_words(F.col("t")).alias("w"))
    table = picked.orderBy("h", "lang", "w").mapInArrow(_sent, _SENT).toArrow()
    examples, labels = [], []
    for batch in table.to_batches(max_chunksize=256):
        examples += [_example(h.as_py(), w.as_py(), _fields(x)) for h, _, w, x in zip(*batch.columns)]
        labels += batch.column(1).to_pylist()
    del table  # the texts are not held beside the examples
    return train(examples, labels)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` plus ``lang_pred`` (``und`` if the text is null or has no letter, or
    no language is known), ``lang_score`` (the calibrated probability of the language
    predicted; 0 for ``und``) and ``lang_rejected`` (``und``, or a score below the
    model's bound for the text's length). Ties go to the smaller name. Columns of those names are replaced;
    repeated rows are judged alike; an empty table gives an empty result. No
    shuffle; the model is of fixed size."""
    # plain values: a broadcast is unpickled where this package need not be installed
    shared = docs.sparkSession.sparkContext.broadcast(model.values())

    @F.arrow_udf("lang string, score double, small boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = LanguageModel(*shared.value)
        names = np.array(model.languages, dtype=object)
        for words in batches:
            batch = pa.RecordBatch.from_arrays([words], names=["w"])
            lang, score, small = [], [], []
            for lo, hi in text_groups(batch, 0, PIECE_CHARS):
                p, rejected = model.probabilities(batch.column(0)[lo:hi].to_pylist())
                lang += names[p.argmax(axis=1)].tolist()
                score += p.max(axis=1).tolist()
                small += rejected.tolist()
            columns = pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(small, pa.bool_())
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "small"])

    text = F.col(text_col)
    new = ["lang_pred", "lang_score", "lang_rejected"]
    kept = [c for c in docs.columns if c not in new]
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    row = F.struct(*[docs[c] for c in kept]).alias("__row")
    out = docs.select(row, letters.alias("__letters"), text.alias("__text"))
    if model.languages:  # normalised on the way to the worker, not kept with the rows
        out = out.withColumn("__p", predict(normal_words(F.col("__text"))))
        lang, score, small = F.col("__p.lang"), F.col("__p.score"), F.col("__p.small")
    else:
        lang, score, small = F.lit(UNKNOWN), F.lit(0.0), F.lit(True)
    lang = F.when(F.col("__letters"), lang).otherwise(F.lit(UNKNOWN))
    score = F.when(F.col("__letters"), score).otherwise(F.lit(0.0))
    rejected = ~F.col("__letters") | small
    return out.select("__row.*", lang.alias("lang_pred"), score.alias("lang_score"), rejected.alias("lang_rejected"))
