"""One registered query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockpipe.llm import language, toxicity
from blockpipe.llm.ann import nearest_neighbours
from blockpipe.llm.caps import linked_vectors
from blockpipe.llm.common import crc32_of_id, only
from blockpipe.llm.decontaminate import find_passages
from blockpipe.llm.licenses import scan_licenses, scan_sql
from blockpipe.llm.neardup import near_duplicates
from blockpipe.llm.packing import pack_documents
from blockpipe.llm.repair import damaged, repair_conversations
from blockpipe.llm.shards import shard_rows
from blockpipe.llm.spelling import spelling_groups
from blockpipe.llm.urls import filter_sql, filter_urls
from blockpipe.llm.warc import read_warc, write_warc
from blockpipe.session import scratch_path

SHARDS = 40
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op8_license_digests", scan_sql())
def op8(spark, sf):
    docs = only(table(spark, sf, "documents"), "doc_id", "text")
    return scan_licenses(docs).drop("text")


@query("op6_url_vocabulary", filter_sql())
def op6(spark, sf):
    return filter_urls(only(table(spark, sf, "pages"), "page_id", "url")).drop("url")


@query("op2_hypergeometric_shards")
def op2(spark, sf):
    sharded = shard_rows(spark, f"{sf.rstrip('/')}/documents.parquet", SHARDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_histogram_packing")
def op7(spark, sf):
    docs = only(table(spark, sf, "documents"), "doc_id", "text")
    return pack_documents(docs, VOCABULARY, with_ids=False).drop("ids")


@query(
    "op3_warc_roundtrip",
    """
    with p as (select page_id, coalesce(html, '') as h from pages),
    d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
    g as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
    select page_id, payload_bytes, payload_digest,
           case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
           case when first <> page_id then first end as refers_to
    from d left join g using (payload_digest)
    """,
)
def op3(spark, sf):
    path = scratch_path(spark, "warc")
    write_warc(only(table(spark, sf, "pages"), "page_id", "url", "html"), path)
    page_id = F.regexp_extract("record_id", r"(-?\d+)", 1).try_cast("long")
    responses = read_warc(spark, path).where("record_type = 'response'").select(
        page_id.alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        page_id.alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_extract("payload_digest", "sha256:(.*)", 1).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"(-?\d+)", 1).cast("long").alias("refers_to"),
    )
    return responses.unionAll(revisits)


@query("op9_simhash_decontamination")
def op9(spark, sf):
    return find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_order_minhash")
def op5(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


def fold_of(folds: int) -> Column:
    return F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds))


@query("op4_toxicity_ratios")
def op4(spark, sf):
    docs = only(table(spark, sf, "documents"), "doc_id", "text")
    labels = only(table(spark, sf, "labels"), "doc_id", "toxic")
    model = toxicity.fit(docs.where(fold_of(3) != 1), labels.where(fold_of(3) != 1))
    score = F.col("toxicity")
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (fold_of(3) == 1).alias("held_out"),
        score.alias("score"),
        F.when(score >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@query("op10_language_id")
def op10(spark, sf):
    docs = only(table(spark, sf, "documents"), "doc_id", "text", "lang")
    model = language.fit(docs.where(fold_of(4) != 2))
    return language.identify(docs.drop("lang"), model).select(
        "doc_id",
        (fold_of(4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


@query("op1_graph_neighbours")
def op1(spark, sf):
    vectors = only(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


@query("op11_cap_filters")
def op11(spark, sf):
    return linked_vectors(only(table(spark, sf, "embeddings"), "vec_id", "embedding"))


@query("op12_frequency_trie")
def op12(spark, sf):
    return spelling_groups(only(table(spark, sf, "documents"), "doc_id", "text"))


@query("op13_hirschberg_repair")
def op13(spark, sf):
    turns = only(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return repair_conversations(damaged(turns), present_col="present")
