import pytest
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe.plans import (
    BLOCKS_DDL,
    Block,
    ModelError,
    PipelineError,
    block_adjacency,
    pandas_block,
    read_model,
    run_block,
    run_model,
    run_pipeline,
)

# --- F: SQL models --------------------------------------------------------------------------


def test_run_model_view_with_dataframe_sources(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, g string")
    out = run_model(spark, "counts_by_g", "select g, count(*) as n from {src} group by g", sources={"src": src},
                    comments={"n": "rows per g"})
    assert {r.g: r.n for r in out.collect()} == {"a": 2, "b": 1}
    assert read_model(spark, "counts_by_g").schema["n"].metadata.get("comment") == "rows per g"


def test_run_model_table_and_source_refs(spark):
    spark.sql("create database if not exists raw")
    spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, amount double").write.mode("overwrite").saveAsTable("raw.sales")
    sql = "select id, amount * 2 as doubled from {{ source('raw', 'sales') }}"
    out = run_model(spark, "sales_x2", sql, materialized="table", schema="main",
                    comments={"doubled": "twice the amount"}, table_comment="demo")
    assert sorted(r.doubled for r in out.collect()) == [20.0, 40.0]
    described = {r.col_name: r.comment for r in spark.sql("describe table main.sales_x2").collect()}
    assert described["doubled"] == "twice the amount"
    again = run_model(spark, "sales_x2", sql.replace("* 2", "* 3"), materialized="table", schema="main")
    assert sorted(r.doubled for r in again.collect()) == [30.0, 60.0]
    view = run_model(spark, "sales_v", sql, materialized="view", schema="main")
    assert view.count() == 2


def test_run_model_reports_engine_error(spark):
    with pytest.raises(ModelError) as err:
        run_model(spark, "broken", "select no_such_column from range(3)")
    assert "no_such_column" in str(err.value)


# --- G: blocks --------------------------------------------------------------------------------


def test_run_block_results(spark):
    df = spark.range(3)
    assert run_block(lambda df=None: df.where("id > 0"), df=df).count() == 2
    col = run_block(lambda df=None: (F.col("id") * 2).alias("x"), df=df)
    assert col.columns == ["x"]
    first = run_block(lambda df=None: df, df={"a": df, "b": spark.range(9)})
    assert first.count() == 3
    with pytest.raises(TypeError):
        run_block(lambda df=None: 42, df=df)


def test_run_block_df_overrides_argument(spark):
    seen = {}

    def fn(df=None, n=1):
        seen["rows"] = df.count()
        return df.limit(n)

    run_block(fn, df=spark.range(5), n=2)
    assert seen["rows"] == 5


def test_pandas_block_grouped_and_batches(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "id int, g string, v double")

    def center(pdf):
        return pdf.assign(v=pdf.v - pdf.v.mean())

    out = {r.id: r.v for r in pandas_block(df, center, "id int, g string, v double", keys=["g"]).collect()}
    assert out == {1: -1.0, 2: 1.0, 3: 0.0}

    def double(pdf):
        return pdf.assign(v=pdf.v * 2)

    assert sorted(r.v for r in pandas_block(df, double, "id int, g string, v double").collect()) == [2.0, 6.0, 10.0]


# --- H1: pipelines ------------------------------------------------------------------------------


def test_run_pipeline_fanout_and_order(spark):
    def source(spark):
        return spark.range(10)

    blocks = [
        Block("evens", lambda df: df.where("id % 2 = 0"), source="src"),
        Block("src", source),
        Block("odds", lambda df: df.where("id % 2 = 1"), source="src"),
        Block("big_odds", lambda df, k: df.where(F.col("id") > k), source="odds", args={"k": 5}),
    ]
    out = run_pipeline(spark, blocks)
    assert out["evens"].count() == 5 and out["big_odds"].count() == 2
    assert out["src"].storageLevel.useMemory  # shared by two blocks: persisted


def test_run_pipeline_errors(spark):
    ident = lambda df: df
    with pytest.raises(PipelineError, match="cycle"):
        run_pipeline(spark, [Block("a", ident, source="b"), Block("b", ident, source="a")])
    with pytest.raises(PipelineError, match="missing"):
        run_pipeline(spark, [Block("a", ident, source="gone")])


def test_pipeline_minimum_slice(spark):
    from blockpipe import suite

    out = run_pipeline(spark, suite.net_by_priority_blocks("/root/testdata/sf0.001"))
    assert out["summary"].count() == 5
    assert ops.preview(out["summary"], 2, order_by=["o_orderpriority"]).count() == 2


# --- H2: lineage ----------------------------------------------------------------------------------


def _graph(spark, blocks, project="p"):
    """blocks: (block, section, section_pos, block_pos, source_section, source_block[, type, setup, code])"""
    rows = []
    for b in blocks:
        name, sec, spos, bpos, ssec, sblk = b[:6]
        stype = b[6] if len(b) > 6 else "Transformation"
        setup = b[7] if len(b) > 7 else True
        code = b[8] if len(b) > 8 else True
        rows.append((project, spos, stype, bpos, name, setup, code, ssec, sblk))
    return spark.createDataFrame(rows, BLOCKS_DDL)


def _adj(df):
    return {r.block: list(r.adj) for r in block_adjacency(df).collect()}


def test_adjacency_linear(spark):
    g = _graph(spark, [("b1", "s1", 1, 1, None, None), ("b2", "s1", 1, 2, "s1", "b1"), ("b3", "s2", 2, 1, "s1", "b2")])
    assert _adj(g) == {"b1": ["b2"], "b2": ["b3"], "b3": []}


def test_adjacency_diamond(spark):
    g = _graph(spark, [("b1", "s1", 1, 1, None, None), ("b2", "s1", 1, 2, "s1", "b1"),
                       ("b3", "s1", 1, 3, "s1", "b1"), ("b4", "s1", 1, 4, "s1", "b3")])
    assert _adj(g) == {"b1": ["b2", "b3"], "b2": [], "b3": ["b4"], "b4": []}


def test_adjacency_disconnected(spark):
    g = _graph(spark, [("b1", "s1", 1, 1, None, None), ("b2", "s1", 1, 2, "s1", "b1"),
                       ("b3", "s2", 2, 1, None, None), ("b4", "s2", 2, 2, "s2", "b3")])
    assert _adj(g) == {"b1": ["b2"], "b2": [], "b3": ["b4"], "b4": []}


def test_adjacency_complex(spark):
    g = _graph(spark, [("b1", "s1", 1, 1, None, None), ("b2", "s1", 1, 2, "s1", "b1"),
                       ("b3", "s1", 1, 3, "s1", "b1"), ("b4", "s2", 2, 1, "s1", "b2"),
                       ("b5", "s2", 2, 2, "s1", "b3"), ("b6", "s2", 2, 3, "s2", "b5")])
    assert _adj(g) == {"b1": ["b2", "b3"], "b2": ["b4"], "b3": ["b5"], "b4": [], "b5": ["b6"], "b6": []}


def test_adjacency_edge_rows(spark):
    g = _graph(spark, [
        ("b1", "s1", 1, 1, None, None),
        ("o1", "s9", 9, 1, "s1", "b1", "Orchestration"),        # skipped section
        ("nc", "s1", 1, 2, "s1", "b1", "Cleaning", True, False),  # no code: skipped
        ("b2", "s1", 1, 3, "s1", "deleted"),                     # source gone: still a key
        ("b3", "s1", 1, 4, None, "b1"),                          # one source id: no edge
        ("b4", "s2", 2, 1, "", "b1"),                            # empty id: no edge
        ("b5", "s1", 1, 0, "s1", "b1"),                          # block order decides list order
    ])
    assert _adj(g) == {"b1": ["b5"], "b2": [], "b3": [], "b4": [], "b5": [], "deleted": ["b2"]}


def test_adjacency_many_projects(spark):
    a = _graph(spark, [("b1", "s1", 1, 1, None, None), ("b2", "s1", 1, 2, "s1", "b1")], project="p1")
    b = _graph(spark, [("b1", "s1", 1, 1, None, None)], project="p2")
    rows = {(r.project, r.block): list(r.adj) for r in block_adjacency(a.union(b)).collect()}
    assert rows == {("p1", "b1"): ["b2"], ("p1", "b2"): [], ("p2", "b1"): []}


def test_run_pipeline_with_snapshots(spark, tmp_dir):
    def source(spark):
        return {"a": spark.range(4), "b": spark.range(2)}

    blocks = [
        Block("src", source),
        Block("double", lambda df: df.select((F.col("id") * 2).alias("x")), source="src"),
    ]
    out = run_pipeline(spark, blocks, snapshot_dir=tmp_dir)
    assert sorted(out["src"]) == ["a", "b"]
    assert sorted(r.x for r in out["double"].collect()) == [0, 2, 4, 6]
    from blockpipe.sources import load_snapshot

    assert load_snapshot(spark, f"{tmp_dir}/double")["result"].count() == 4


def test_run_model_with_catalog_source_names(spark):
    spark.range(5).write.mode("overwrite").saveAsTable("five_rows")
    out = run_model(spark, "odd_rows", "select id from {t} where id % 2 = 1", sources={"t": "five_rows"})
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_pandas_block_refuses_oversized_groups(spark):
    from blockpipe.plans import GroupTooLargeError

    df = spark.range(100).withColumn("g", F.when(F.col("id") < 60, 0).otherwise(F.col("id")))
    with pytest.raises(GroupTooLargeError):
        pandas_block(df, lambda pdf: pdf, "id bigint, g bigint", keys=["g"], max_group_rows=50)
    assert pandas_block(df, lambda pdf: pdf, "id bigint, g bigint", keys=["g"], max_group_rows=60).count() == 100


def test_blocks_table_feeds_adjacency(spark):
    from blockpipe.plans import blocks_table

    ident = lambda df: df
    blocks = [
        Block("load", ident, section="movement", section_type="Movement"),
        Block("clean", ident, source="load", section="cleaning", section_type="Cleaning"),
        Block("agg", ident, source="clean", section="transform"),
        Block("feat", ident, source="clean", section="transform"),
        Block("dag", ident, source="agg", section="orchestrate", section_type="Orchestration"),
    ]
    adj = {r.block: list(r.adj) for r in block_adjacency(blocks_table(spark, "p", blocks)).collect()}
    assert adj == {"load": ["clean"], "clean": ["agg", "feat"], "agg": [], "feat": []}



def test_failing_block_is_named(spark):
    def boom(df):
        raise ValueError("bad input")

    with pytest.raises(PipelineError, match="'check' failed: bad input") as err:
        run_pipeline(spark, [Block("src", lambda spark: spark.range(3)), Block("check", boom, source="src")])
    assert isinstance(err.value.__cause__, ValueError)
