"""H1: single blocks run from saved outputs; snapshots that hold are not computed again."""

import os

import pytest
from pyspark.sql import functions as F

from blockpipe.plans import Block, PipelineError, resume_pipeline, run_pipeline

CALLS = []


def chain(folder, factor=2, keep=3):
    def read(spark):
        CALLS.append("read")
        return spark.read.parquet(folder)

    def scaled(df, by):
        CALLS.append("scaled")
        return df.withColumn("v", F.col("v") * by)

    def kept(df, least):
        CALLS.append("kept")
        return df.where(F.col("v") >= least)

    def total(df):
        CALLS.append("total")
        return df.agg(F.sum("v").alias("total"))

    return [
        Block("read", read, snapshot=False),
        Block("scaled", scaled, source="read", args={"by": factor}),
        Block("kept", kept, source="scaled", args={"least": keep}),
        Block("total", total, source="kept"),
    ]


@pytest.fixture()
def data(spark, tmp_dir):
    spark.range(10).select(F.col("id").alias("v")).write.parquet(f"{tmp_dir}/data")
    CALLS.clear()
    return f"{tmp_dir}/data", f"{tmp_dir}/saved"


def value(run):
    return run.outputs["total"].first()[0]


def test_second_run_reads_one_snapshot_and_computes_nothing(spark, data):
    folder, saved = data
    first = resume_pipeline(spark, chain(folder), saved)
    assert value(first) == sum(2 * v for v in range(10) if 2 * v >= 3)
    assert first.computed == ["read", "scaled", "kept", "total"] and not first.reused
    CALLS.clear()
    second = resume_pipeline(spark, chain(folder), saved)
    assert (second.computed, second.reused) == ([], ["total"]) and value(second) == value(first)
    assert CALLS == ["read"]  # only to see its files
    plan = second.outputs["total"]._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan.split("saved")[0] and "Exchange" not in plan


def test_changed_argument_recomputes_that_block_and_those_below(spark, data):
    folder, saved = data
    resume_pipeline(spark, chain(folder), saved)
    run = resume_pipeline(spark, chain(folder, keep=9), saved)
    assert (run.computed, run.reused) == (["kept", "total"], ["scaled"])
    assert value(run) == sum(2 * v for v in range(10) if 2 * v >= 9)
    back = resume_pipeline(spark, chain(folder), saved)  # the earlier version is still known
    assert (back.computed, back.reused) == ([], ["total"])


def test_one_block_alone_from_saved_upstream(spark, data):
    folder, saved = data
    up = resume_pipeline(spark, chain(folder), saved, only="scaled")
    assert up.computed == ["read", "scaled"] and list(up.outputs) == ["scaled"]
    CALLS.clear()
    run = resume_pipeline(spark, chain(folder), saved, only="kept")
    assert (run.computed, run.reused) == (["kept"], ["scaled"]) and "scaled" not in CALLS
    forced = resume_pipeline(spark, chain(folder), saved, only="total", force=["kept"])
    assert (forced.computed, forced.reused) == (["kept", "total"], ["scaled"])


def test_changed_data_code_and_reads_are_noticed(spark, data, tmp_dir):
    folder, saved = data
    resume_pipeline(spark, chain(folder), saved)
    spark.range(10, 12).select(F.col("id").alias("v")).write.mode("append").parquet(folder)
    run = resume_pipeline(spark, chain(folder), saved)
    assert run.computed == ["read", "scaled", "kept", "total"]
    assert value(run) == sum(2 * v for v in range(12) if 2 * v >= 3)

    blocks = chain(folder)
    blocks[3].fn = lambda df: df.agg(F.max("v").alias("total"))
    other = resume_pipeline(spark, blocks, saved)
    assert (other.computed, other.reused) == (["total"], ["kept"]) and value(other) == 22

    spark.range(3).write.parquet(f"{tmp_dir}/side")
    blocks[3].reads = [f"{tmp_dir}/side"]
    assert resume_pipeline(spark, blocks, saved).computed == ["total"]
    assert resume_pipeline(spark, blocks, saved).computed == []
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_dir}/side")
    assert resume_pipeline(spark, blocks, saved).computed == ["total"]


def test_several_datasets_and_a_table_without_files(spark, tmp_dir):
    def read(spark):
        return {"a": spark.range(3), "b": spark.range(5).where("id > 10")}

    blocks = [Block("read", read), Block("n", lambda df: df.agg(F.count("*").alias("n")), source="read")]
    first = resume_pipeline(spark, blocks, f"{tmp_dir}/s", only=["read", "n"])
    again = resume_pipeline(spark, blocks, f"{tmp_dir}/s", only=["read", "n"])
    assert first.computed == again.reused == ["read", "n"]
    assert again.outputs["read"]["b"].count() == 0 and again.outputs["n"].first()[0] == 3


def test_unknown_block_and_cycle_fail_before_anything_runs(spark, data):
    folder, saved = data
    with pytest.raises(PipelineError, match="no block"):
        resume_pipeline(spark, chain(folder), saved, only="missing")
    assert not CALLS and not os.path.exists(saved)


def test_persisted_outputs_are_released(spark):
    blocks = [
        Block("read", lambda spark: spark.range(5), snapshot=False),
        Block("a", lambda df: df, source="read"),
        Block("b", lambda df: df.where("id > 1"), source="read"),
    ]
    with run_pipeline(spark, blocks) as out:
        assert out["b"].count() == 3 and out["read"].storageLevel.useMemory
        shared = out["read"]
    assert not shared.storageLevel.useMemory and not out.persisted and out["b"].count() == 3
