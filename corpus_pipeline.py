"""The corpus pipeline: language, toxicity, near duplicates, contamination, packing.

Every stage takes the documents that its predecessor kept, whatever other columns
they have; all but the last return the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockpipe.llm import decontaminate, language, neardup, packing, toxicity
from blockpipe.llm.common import written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TEXT = "__row.text"


def _judged(docs: DataFrame, judge, reject: Column) -> DataFrame:
    """The rows of ``docs`` that ``judge`` does not reject. It is given each row as one
    column, so no name can clash, and the text as a field of that, so a row that
    waits for its answer holds its text once."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return judge(rows).where(~reject).select("__row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence. Those without a letter, null
    and empty ones included, go, and those below the calibrated bound."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return _judged(docs, lambda rows: language.identify(rows, model, text_col=TEXT), F.col("lang_rejected"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; all labels of documents that are
    still there train the model."""
    model = toxicity.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    reject = F.col("toxicity") >= toxicity.THRESHOLD
    return _judged(docs, lambda rows: toxicity.score_toxicity(rows, model, text_col=TEXT), reject)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated
    rows of one id and text one. Documents without an id stay, as nothing tells
    them apart."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text"))
    kept = classes.where(F.col("keep") & F.col("doc_id").isNotNull()).groupBy("doc_id")
    kept = written(kept.agg(F.count(F.lit(1)).alias("n")), "kept-ids")
    once = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    if not kept.where("n > 1").isEmpty():
        again = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi")
        once = once.unionAll(again.dropDuplicates(["doc_id", "text"]))
    return once.unionAll(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _judged(
        docs, lambda rows: decontaminate.flag_passages(rows, benchmark, text_col=TEXT), F.col("contaminated")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), VOCABULARY, with_ids=False).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]
# classifiers, sketches and the tokenizer are beyond SQL; tests/llm holds each stage
# against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written and read back."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
