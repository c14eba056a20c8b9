"""The classifiers against plain versions; packing and passages in odd places."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockpipe.llm import decontaminate, language, packing, queries, toxicity
from blockpipe.llm.ngrams import ngrams, pieces

STEMS = {
    "aa": ["bana", "mango", "papaya", "kokoa", "ananas", "guava"],
    "bb": ["skrift", "blomst", "krydd", "strom", "fjord", "trygg"],
    "cc": ["quixel", "vexiqo", "juxtaz", "zyqqar", "wixxon", "oxyqua"],
}


def prose(lang: str, words: int, rng: random.Random) -> str:
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "s", "en", "ia"]) for _ in range(words))


def labelled(spark, langs, n, words, seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(lang, rng.randrange(*words[lang]), rng), lang) for i, lang in enumerate(langs * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_ngrams(text: str) -> Counter:
    """An n-gram by its letters, from a word with a blank on either side."""
    found = Counter()
    for word in text.split():
        padded = f" {word} "
        for n in (3, 4, 5):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def plain_bucket(gram: str, bits: int) -> int:
    most = 1 << 32
    h = ord(gram[0]) * 0x9E3779B1 % most
    for c in gram[1:]:
        h = (h ^ ord(c)) * 0x85EBCA6B % most
        h ^= h >> 13
    h = (h * 0xC2B2AE35 + len(gram)) % most
    return (h ^ (h >> 16)) * 0x27D4EB2F % most >> (32 - bits)


def test_ngrams_are_those_of_each_word():
    texts = ["a bc déf ", "", "longerword x ", "q "]
    owner, bucket = ngrams(texts, 17)
    for i, text in enumerate(texts):
        want = Counter()
        for gram, times in plain_ngrams(text).items():
            want[plain_bucket(gram, 17)] += times
        assert Counter(bucket[owner == i].tolist()) == want


def test_pieces_have_the_texts_ngrams():
    rng = random.Random(2)
    texts = [prose("aa", n, rng) + " " for n in (1, 400, 3, 90)] + ["", "x" * 500 + " y ", "z" * 300]
    for most in (50, 100, 1000):
        joined = [""] * len(texts)
        sums = [Counter() for _ in texts]
        for owners, group in pieces(texts, most):
            owner, bucket = ngrams(group, 17)
            for k, (i, piece) in enumerate(zip(owners, group)):
                joined[i] += piece
                sums[i].update(bucket[owner == k].tolist())
        assert joined == texts
        for text, got in zip(texts, sums):
            assert got == Counter(ngrams([text], 17)[1].tolist())


def test_language_scores_are_those_of_a_plain_sum(spark):
    docs = labelled(spark, ["aa", "bb"], 30, {"aa": (3, 40), "bb": (3, 40)})
    model = language.fit(docs)
    for row in language.identify(docs, model).limit(10).collect():
        margin, many = np.array(model.intercepts, dtype=float), 0
        total = np.zeros(len(model.languages))
        for gram, times in plain_ngrams(row["text"]).items():
            total += times * model.logits[plain_bucket(gram, language.BITS)].astype(float)
            many += times
        margin += total / many
        p = np.exp(margin / model.temperature)
        p /= p.sum()
        assert row["lang_pred"] == model.languages[int(p.argmax())]
        assert row["lang_score"] == pytest.approx(p.max(), abs=1e-6)
        assert row["lang_rejected"] == (p.max() < model.least[int(np.log2(many + 1))])


def test_what_was_not_learned_is_rejected_and_what_was_is_not(spark):
    docs = labelled(spark, ["aa", "bb"], 300, {"aa": (2, 120), "bb": (2, 120)})
    model = language.fit(docs)
    rng = random.Random(8)
    odd = [prose("cc", 30, rng) for _ in range(40)] + ["".join(rng.choices("xkzvqw ", k=200)) for _ in range(40)]
    odd += ["Это совсем другой язык, которого никто не учил " * 3] * 5
    new = [(lang, prose(lang, n, rng)) for lang in ("aa", "bb") for n in [1, 2, 3, 5, 8, 20, 100] * 20]
    rows = [("und0", t) for t in odd] + new
    df = spark.createDataFrame(rows, "kind string, text string").withColumn("doc_id", F.lit(0))
    got = language.identify(df, model).collect()
    kept_odd = sum(not r["lang_rejected"] for r in got if r["kind"] == "und0")
    lost = sum(r["lang_rejected"] for r in got if r["kind"] != "und0")
    wrong = sum(r["lang_pred"] != r["kind"] for r in got if r["kind"] != "und0")
    assert kept_odd <= 0.05 * len(odd) and lost <= 0.02 * len(new) and wrong <= 0.02 * len(new)


def test_a_language_of_long_texts_only_is_learned(spark):
    docs = labelled(spark, ["aa", "bb"], 15, {"aa": (4000, 4500), "bb": (5, 30)})
    assert docs.where(F.col("lang") == "aa").select(F.min(F.length("text"))).first()[0] > language.SENT_CHARS
    model = language.fit(docs)
    assert model.languages == ["aa", "bb"]
    got = language.identify(docs, model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in got} == {("aa", "aa"), ("bb", "bb")}


def test_long_examples_are_sent_as_they_are_made_here():
    rng = random.Random(1)
    text = prose("aa", 5000, rng) + " "
    batch = pa.RecordBatch.from_pydict({"h": [77], "lang": ["aa"], "w": [text]})
    sent = next(iter(language._sent(iter([batch])))).to_pylist()[0]
    a, b = language._example(77, sent["w"], sent["x"]), language.Example(text, 77)
    assert sent["w"] is None and a.many == b.many and a.views == b.views and a.snippets == b.snippets
    assert a.buckets.tolist() == b.buckets.tolist() and a.shares.tolist() == b.shares.tolist()


def test_language_judges_clashing_columns_and_very_long_texts(spark):
    docs = labelled(spark, ["aa", "bb"], 30, {"aa": (3, 40), "bb": (3, 40)})
    model = language.fit(docs)
    rng = random.Random(4)
    long = prose("bb", 500_000, rng)
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("__w", "__letters", "__row", "__p")})
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert got[1]["lang_pred"] == "bb" and not got[1]["lang_rejected"] and got[1]["__w"] == "x"
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und"


def test_toxicity_scores_are_those_of_a_plain_sum(spark):
    rng = random.Random(6)
    rows = [(i, prose("aa" if i % 2 else "bb", rng.randrange(3, 30), rng), i % 2) for i in range(200)]
    rows += [(500, prose("aa", 60_000, rng), 1), (501, None, None), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    toxic, other = Counter(), Counter()
    for _, text, label in rows:
        if label is not None:
            (toxic if label else other).update({plain_bucket(g, toxicity.BITS) for g in plain_ngrams(text)})
    n_toxic, n_other = 101, 100
    for bucket in set(toxic) | set(other):  # weights only where the log-count ratio is clear
        p, q = toxic[bucket] + 0.5, other[bucket] + 0.5
        ratio = np.log(p / (n_toxic + 1)) - np.log(q / (n_other + 1))
        if abs(ratio) < toxicity.MIN_Z * np.sqrt(1 / p + 1 / q):
            assert model.weights[bucket] == 0
    assert (model.weights != 0).any()
    for row in toxicity.score_toxicity(df, model).collect():
        text = row["text"] or ""
        words, counts = len(text.split()), Counter()
        for gram, times in plain_ngrams(text).items():
            counts[plain_bucket(gram, toxicity.BITS)] += times
        margin = model.intercept + sum(
            float(model.weights[b]) * np.sqrt(100 * t / (words + toxicity.SPARE_WORDS)) for b, t in counts.items()
        )
        assert row["toxicity"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=0.02 if words < 3 else 1e-4)
        if row["toxic"] is not None:
            assert (row["toxicity"] >= 0.5) == bool(row["toxic"])


@pytest.mark.parametrize("lost", [(0.1, 0.0), (0.0, 0.1), (0.05, 0.05), (0.08, 0.02), (0.02, 0.09)])
def test_passages_cut_at_both_ends_are_found(spark, lost):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(30, 300)))) for k in range(120)]
    docs = []
    for k, text in items:
        words = text.split()
        body = words[int(lost[0] * len(words)) : len(words) - int(lost[1] * len(words))]
        docs.append((k, " ".join(rng.choices(vocabulary, k=50) + body + rng.choices(vocabulary, k=50))))
    found = decontaminate.find_passages(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    pairs = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert all(d == k and s >= 0.8 for (d, k), s in pairs.items())
    for k, text in items:  # by the plain definition, over every window as long as the item
        words, body = text.split(), docs[k][1].split()
        own = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        best = 0.0
        for at in range(len(body) - len(words) + 1):
            here = Counter(tuple(body[i : i + 5]) for i in range(at, at + len(words) - 4))
            common = sum((own & here).values())
            best = max(best, common / (sum(own.values()) + sum(here.values()) - common))
        if best >= 0.82:  # nearer to 0.8 the window's place may cost a word
            assert (k, k) in pairs


def test_running_bits_of_long_runs():
    words = np.random.default_rng(1).integers(0, 2**63, 70_000).astype(np.uint64)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    plain = np.cumsum(bits, axis=0, dtype=np.int64)
    assert (decontaminate.running_bits(words, 100)[1:] == plain % 256).all()
    assert (decontaminate.running_bits(words, 1000)[1:] == plain % 65536).all()
    ones = np.stack([bits[i : i + 30].sum(axis=0) for i in range(200)])
    prints = decontaminate.fingerprints(decontaminate.running_bits(words[:229], 100), 30)
    assert (np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1) == (ones > 15)).all()


def test_repeated_rows_are_ranked_in_parts(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    pieces = packing.tokenize(rows, queries.VOCABULARY, with_ids=False)
    length = pieces.first()["length"]
    ranked = packing.ranked_by_length(pieces, {length: 5000}, 100)
    assert sorted(r["__rank"] for r in ranked.select("__rank").collect()) == list(range(5000))
    shares = pieces.withColumn("p", F.monotonically_increasing_id()).select(
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "p"), F.lit(50)).alias("s")
    )
    assert shares.groupBy("s").count().agg(F.max("count")).first()[0] < 200


def test_examples_take_few_bytes_and_give_the_shares():
    text = "".join(f"word{i % 700} " for i in range(3_000))
    x = language.Example(text, 5)
    _, bucket = language.ngrams([text], language.BITS)
    buckets, counts = np.unique(bucket, return_counts=True)
    assert x.buckets.tolist() == buckets.tolist() and x.shares.tolist() == (counts / counts.sum()).tolist()
    assert x.buckets.nbytes + x.counts.nbytes <= 6 * len(buckets)
    (sent,) = language._sent(iter([pa.RecordBatch.from_pydict({"h": [5], "lang": ["en"], "w": [text]})]))
    assert len(text) > language.SENT_CHARS and sent.column(2)[0].as_py() is None
    y = language._example(5, None, language._fields(sent.column(3)[0]))
    for name in ("buckets", "counts"):
        assert getattr(y, name).dtype == getattr(x, name).dtype and getattr(y, name).tolist() == getattr(x, name).tolist()
    assert (y.views, y.snippets, y.many) == (x.views, x.snippets, x.many)
