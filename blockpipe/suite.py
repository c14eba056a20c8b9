"""Regression queries: each block run on the driver tables, with DuckDB SQL
that computes the same result for the correctness check.

Every query reads whole tables. Numbers that come out of sums, averages or
interpolation are rounded on both sides so engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockpipe import operators as ops
from blockpipe.plans import (
    Block,
    block_adjacency,
    ensure_database,
    pandas_block,
    read_model,
    run_block,
    run_model,
    run_pipeline,
    resume_pipeline,
)
from blockpipe.session import scratch_path
from blockpipe import sources as io

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with every 7th value missing (the tables have no nulls)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ev.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


EV0 = (
    "(select event_id, user_id, event_type, "
    "case when event_id % 7 <> 0 then value end as value from events)"
)


# --- H1 + A1 + C1 + D8 + D6: the minimum slice, as linked blocks ---------------------------


def net_by_priority_blocks(sf_dir: str) -> list[Block]:
    """Read -> drop missing -> net price -> per order -> join orders -> per priority.

    The read block names its columns, so the scan reads three of lineitem's
    columns. Summing per order before the join is an eager aggregation: the
    partial aggregate shrinks lineitem map-side, and its hash partitioning on
    the order key is the one the join needs, so the join adds no exchange on
    that side.
    """

    def read(spark, name, columns):
        return table(spark, sf_dir, name).select(*columns)

    def net_price(df):
        return ops.construct(df, {"net": "l_extendedprice * (1 - l_discount)"})

    def per_order(df):
        return ops.aggregate(df, "l_orderkey", {"net": ("sum", "net"), "n": ("count", "*")})

    def with_orders(df, spark):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        return ops.join_on_keys(df, orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")

    def per_priority(df):
        return ops.aggregate(
            df,
            "o_orderpriority",
            {"net": F.round(F.sum("net"), 2), "n": F.sum("n")},
        )

    return [
        Block("lineitem", read, args={"name": "lineitem",
                                      "columns": ["l_orderkey", "l_extendedprice", "l_discount"]},
              snapshot=False),
        Block("complete", ops.drop_missing, source="lineitem", snapshot=False),
        Block("priced", net_price, source="complete", snapshot=False),
        Block("orders_net", per_order, source="priced"),
        Block("joined", with_orders, source="orders_net", reads=[f"{sf_dir.rstrip('/')}/orders.parquet"]),
        Block("summary", per_priority, source="joined"),
    ]


@query(
    "net_by_priority",
    """
    select o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as net,
           count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey
    group by o_orderpriority
    """,
)
def q_net_by_priority(spark, sf):
    return run_pipeline(spark, net_by_priority_blocks(sf))["summary"]


@query("net_by_priority_snapshots", ORACLE_SQL["net_by_priority"])
def q_net_by_priority_snapshots(spark, sf):
    """The same pipeline with the outputs of all blocks but the row-local ones saved and read back."""
    out = run_pipeline(spark, net_by_priority_blocks(sf), snapshot_dir=scratch_path(spark, "pipeline"))
    return out["summary"]


@query("net_by_priority_resumed", ORACLE_SQL["net_by_priority"])
def q_net_by_priority_resumed(spark, sf):
    """The same pipeline: its joined block run alone and saved, then the rest from there."""
    saved = scratch_path(spark, "resumed")
    resume_pipeline(spark, net_by_priority_blocks(sf), saved, only="joined")
    return resume_pipeline(spark, net_by_priority_blocks(sf), saved).outputs["summary"]


# --- B: preview and profile ------------------------------------------------------------------


@query("preview", "select * from orders order by o_orderkey limit 10")
def q_preview(spark, sf):
    return ops.preview(table(spark, sf, "orders"), 10, order_by=["o_orderkey"])


@query(
    "preview_records",
    """
    select * from (
        select 'orders' as dataset,
               cast(to_json(struct_pack(o_orderkey, o_custkey, o_orderstatus, o_totalprice,
                                        o_orderdate := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'),
                                        o_orderpriority)) as varchar) as record
        from orders order by o_orderkey limit 10)
    union all
    select * from (
        select 'events' as dataset,
               cast(to_json(struct_pack(event_id, ts := strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), user_id,
                                        event_type, value, props)) as varchar) as record
        from events order by event_id limit 10)
    """,
)
def q_preview_records(spark, sf):
    dfs = {"orders": table(spark, sf, "orders"), "events": table(spark, sf, "events")}
    return ops.preview_records(dfs, 10, order_by={"orders": ["o_orderkey"], "events": ["event_id"]})


def _profile_sql(src: str, cols: list[tuple[str, str, bool]], dataset: str | None = None) -> str:
    parts = []
    for name, dtype, fractional in cols:
        miss = f"{name} is null" + (f" or isnan({name})" if fractional else "")
        lead = f"'{dataset}' as dataset, " if dataset else ""
        parts.append(
            f"select {lead}'{name}' as column_name, '{dtype}' as data_type, "
            f"coalesce(bool_or({miss}), false) as has_nulls from {src}"
        )
    return "\nunion all\n".join(parts)


@query(
    "schema_profile",
    _profile_sql(
        EV0,
        [("event_id", "bigint", False), ("user_id", "bigint", False),
         ("event_type", "string", False), ("value", "double", True)],
    ),
)
def q_schema_profile(spark, sf):
    return ops.schema_profile(events_with_gaps(spark, sf))


@query(
    "dataset_summary",
    _profile_sql(
        "customer",
        [("c_custkey", "bigint", False), ("c_name", "string", False), ("c_nationkey", "int", False),
         ("c_acctbal", "double", True), ("c_mktsegment", "string", False)],
        "customer",
    )
    + "\nunion all\n"
    + _profile_sql(
        "supplier",
        [("s_suppkey", "bigint", False), ("s_name", "string", False), ("s_nationkey", "int", False),
         ("s_acctbal", "double", True)],
        "supplier",
    ),
)
def q_dataset_summary(spark, sf):
    return ops.dataset_summary({"customer": table(spark, sf, "customer"), "supplier": table(spark, sf, "supplier")})


# --- B5, B6: recommendations ---------------------------------------------------------------------

from blockpipe.operators.recommend import CLEANING_REASONS, TRANSFORMATION_REASONS  # noqa: E402


def _sql_text(template: str, **parts: str) -> str:
    """The SQL twin of the reason builder: literals and SQL expressions joined by ||."""
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        out.append("'" + head.replace("'", "''") + "'")
        out.append(parts[key])
    out.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(out)


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CLEANING_SETS = {
    "events": (
        "(select event_id, user_id, event_type, case when event_id % 7 <> 0 then value end as value, "
        "json_extract_string(props, '$.k') as k_text from events)",
        [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"),
         ("k_text", "string")],
    ),
    "customers": (
        "(select c_custkey, case when c_custkey % 11 = 0 then ' ' || c_name else c_name end as c_name, "
        "c_mktsegment from customer)",
        [("c_custkey", "bigint"), ("c_name", "string"), ("c_mktsegment", "string")],
    ),
    "documents": ("(select text, lang, source from documents)",
                  [("text", "string"), ("lang", "string"), ("source", "string")]),
}


def _cleaning_sql() -> str:
    cands = []
    for ds, (src, cols) in _CLEANING_SETS.items():
        for c, t in cols:
            miss = f"{c} is null" + (f" or isnan({c})" if t == "double" else "")
            reason = _sql_text(CLEANING_REASONS["impute"], c=_lit(c), n="cast(n as varchar)")
            cands.append(f"select {_lit(ds)} as dataset, {_lit(c)} as column_name, 'impute' as technique, "
                         f"{reason} as reason, n as affected_rows "
                         f"from (select count(*) filter (where {miss}) as n from {src}) where n > 0")
            if t == "string":
                strip = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
                reason = _sql_text(CLEANING_REASONS["standardize_text"], c=_lit(c), n="cast(n as varchar)")
                cands.append(f"select {_lit(ds)}, {_lit(c)}, 'standardize_text', {reason}, n "
                             f"from (select count(*) filter (where {c} <> {strip}) as n from {src}) where n > 0")
                reason = _sql_text(CLEANING_REASONS["correct_types"], c=_lit(c), n="cast(n as varchar)")
                cands.append(f"select {_lit(ds)}, {_lit(c)}, 'correct_types', {reason}, n "
                             f"from (select count({c}) as n, count(try_cast({c} as double)) as m from {src}) "
                             f"where n > 0 and n = m")
        allc = ", ".join(c for c, _ in cols)
        reason = _sql_text(CLEANING_REASONS["drop_duplicates"], d=_lit(ds), n="cast(n as varchar)")
        cands.append(f"select {_lit(ds)}, '*', 'drop_duplicates', {reason}, n from "
                     f"(select cast(coalesce(sum(c - 1), 0) as bigint) as n from "
                     f"(select count(*) as c from {src} group by {allc})) where n > 0")
    body = "\nunion all\n".join(cands)
    return (f"select * from (select cast(row_number() over (order by affected_rows desc, dataset, "
            f"column_name, technique) as int) as rank, * from ({body})) where rank <= 5")


@query("recommend_cleaning", _cleaning_sql())
def q_recommend_cleaning(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").alias("k_text"),
    )
    cust = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("c_name"),
        "c_mktsegment",
    )
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    return ops.recommend_cleaning({"events": ev, "customers": cust, "documents": docs})


_TRANSFORM_SETS = {
    "orders": ("(select o_orderkey, o_custkey, o_orderdate from orders)",
               [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderdate", "timestamp")]),
    "customers": ("(select c_custkey as o_custkey, c_mktsegment from customer)",
                  [("o_custkey", "bigint"), ("c_mktsegment", "string")]),
    "parts": ("(select p_partkey, p_name from part)", [("p_partkey", "bigint"), ("p_name", "string")]),
    "customer_names": ("(select c_name as name from customer)", [("name", "string")]),
    "supplier_names": ("(select s_name as name from supplier)", [("name", "string")]),
}


def _transform_sql() -> str:
    prio = {"split_column": 0, "construct": 1, "discretize": 2, "join_on_keys": 3, "union": 4}
    cands = []
    for ds, (src, cols) in _TRANSFORM_SETS.items():
        for c, t in cols:
            if t == "string":
                reason = _sql_text(TRANSFORMATION_REASONS["split_column"], c=_lit(c), n="cast(lo as varchar)")
                cands.append(f"select 0 as priority, {_lit(ds)} as dataset, {_lit(c)} as column_name, "
                             f"'split_column' as technique, {reason} as reason, n as affected_rows from "
                             f"(select count({c}) as n, min(len(string_split({c}, ' '))) as lo, "
                             f"max(len(string_split({c}, ' '))) as hi from {src}) where n > 0 and lo = hi and lo >= 2")
            elif t == "timestamp":
                reason = _sql_text(TRANSFORMATION_REASONS["construct"], c=_lit(c))
                cands.append(f"select 1 as priority, {_lit(ds)} as dataset, {_lit(c)} as column_name, "
                             f"'construct' as technique, {reason} as reason, n as affected_rows "
                             f"from (select count({c}) as n from {src}) where n > 0")
            elif t == "double":
                reason = _sql_text(TRANSFORMATION_REASONS["discretize"], c=_lit(c))
                cands.append(f"select 2 as priority, {_lit(ds)} as dataset, {_lit(c)} as column_name, "
                             f"'discretize' as technique, {reason} as reason, n as affected_rows "
                             f"from (select count({c}) as n from {src}) where n > 0")
    names = list(_TRANSFORM_SETS)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sa, sb = dict(_TRANSFORM_SETS[a][1]), dict(_TRANSFORM_SETS[b][1])
            shared = [c for c in sa if c in sb and sa[c] == sb[c]]
            if shared:
                reason = TRANSFORMATION_REASONS["join_on_keys"].format(d=a, e=b, c=", ".join(shared))
                cands.append(f"select 3 as priority, {_lit(a + ', ' + b)} as dataset, "
                             f"{_lit(', '.join(shared))} as column_name, 'join_on_keys' as technique, "
                             f"{_lit(reason)} as reason, (select count(*) from {_TRANSFORM_SETS[a][0]}) "
                             f"as affected_rows")
            if sa == sb:
                reason = TRANSFORMATION_REASONS["union"].format(d=a, e=b)
                cands.append(f"select 4 as priority, {_lit(a + ', ' + b)} as dataset, '*' as column_name, "
                             f"'union' as technique, {_lit(reason)} as reason, "
                             f"(select count(*) from {_TRANSFORM_SETS[a][0]}) + "
                             f"(select count(*) from {_TRANSFORM_SETS[b][0]}) as affected_rows")
    body = "\nunion all\n".join(cands)
    return (f"select rank, dataset, column_name, technique, reason, affected_rows from ("
            f"select cast(row_number() over (order by priority, dataset, column_name) as int) as rank, * "
            f"from ({body})) where rank <= 5")


@query("recommend_transformations", _transform_sql())
def q_recommend_transformations(spark, sf):
    dfs = {
        "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        "customers": table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
        "parts": table(spark, sf, "part").select("p_partkey", "p_name"),
        "customer_names": table(spark, sf, "customer").select(F.col("c_name").alias("name")),
        "supplier_names": table(spark, sf, "supplier").select(F.col("s_name").alias("name")),
    }
    return ops.recommend_transformations(dfs)


# Columns under names that tell nothing, by kind.
_KEY_SETS = {
    "customers": ("customer", {"a": "c_custkey", "b": "c_nationkey", "c": "c_name"}),
    "orders": ("orders", {"a": "o_orderkey", "d": "o_custkey", "e": "o_orderpriority"}),
    "lines": ("lineitem", {"f": "l_orderkey", "g": "l_partkey", "h": "l_suppkey", "i": "l_linenumber"}),
    "parts": ("part", {"j": "p_partkey", "k": "p_name"}),
    "nations": ("nation", {"l": "n_nationkey", "m": "n_name"}),
}
_KEY_TEXTS = ("c_name", "o_orderpriority", "p_name", "n_name")


def _keys_sql() -> str:
    cols = [(d, out, t, c) for d, (t, named) in _KEY_SETS.items() for out, c in named.items()]
    pairs = []
    for d, x, t, c in cols:
        for e, y, u, k in cols:
            if d != e and (c in _KEY_TEXTS) == (k in _KEY_TEXTS):
                pairs.append(
                    f"select '{d}' as left_dataset, '{x}' as left_column, '{e}' as right_dataset, '{y}' as right_column, "
                    f"(select count(distinct {c}) from {t}) as left_values, "
                    f"(select count(distinct {k}) from {u}) as right_values, (select count({k}) from {u}) as right_rows, "
                    f"(select count(*) from (select distinct {c} as v from {t}) "
                    f"semi join (select {k} as v from {u}) using (v)) as shared_values"
                )
    return f"""
    with pairs as ({" union all ".join(pairs)})
    select * exclude (right_rows), shared_values / left_values as containment, shared_values / right_values as coverage
    from pairs where right_values = right_rows and containment >= 0.95 and coverage >= 0.1
    """


@query("suggest_joins", _keys_sql())
def q_suggest_joins(spark, sf):
    """Foreign keys of five tables found by their values, the columns' names hidden."""
    return ops.suggest_joins({
        d: table(spark, sf, t).select(*[F.col(c).alias(out) for out, c in named.items()])
        for d, (t, named) in _KEY_SETS.items()
    })


# --- C: cleaning -------------------------------------------------------------------------------


@query("drop_missing", f"select * from {EV0} where event_id is not null and user_id is not null "
       "and event_type is not null and value is not null and not isnan(value)")
def q_drop_missing(spark, sf):
    return ops.drop_missing(events_with_gaps(spark, sf))


@query("drop_duplicates", "select min(doc_id) as doc_id from documents group by text")
def q_drop_duplicates(spark, sf):
    docs = table(spark, sf, "documents")
    return ops.drop_duplicates(docs, subset=["text"], keep_by="doc_id").select("doc_id")


@query(
    "impute_mean",
    f"select event_id, round(coalesce(value, avg(value) over ()), 6) as value from {EV0}",
)
def q_impute_mean(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "mean")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(
    "impute_median_by_group",
    f"select event_id, round(coalesce(value, median(value) over (partition by event_type)), 6) "
    f"as value from {EV0}",
)
def q_impute_median_by_group(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "median", by="event_type")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(
    "impute_mode_by_group",
    f"""
    with counts as (
        select event_type, value, count(*) as c from {EV0} where value is not null group by 1, 2
    ), best as (
        select event_type, value as mode_value from (
            select *, row_number() over (partition by event_type order by c desc, value) as rn
            from counts) where rn = 1
    )
    select e.event_id, coalesce(e.value, b.mode_value) as value
    from {EV0} e left join best b on e.event_type = b.event_type
    """,
)
def q_impute_mode_by_group(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "mode", by="event_type")
    return out.select("event_id", "value")


@query(
    "correct_types",
    """
    select o_orderkey, try_cast(case when o_orderkey % 5 = 0 then 'n/a'
                                     else cast(o_totalprice as varchar) end as double) as price
    from orders
    """,
)
def q_correct_types(spark, sf):
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    df = orders.select("o_orderkey", text.alias("price"))
    return ops.correct_types(df, {"price": "double"})


@query(
    "standardize_text",
    r"select p_partkey, upper(regexp_replace(trim(p_name), '\s+', '', 'g')) as p_name from part",
)
def q_standardize_text(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return ops.standardize_text(part, "p_name", case="upper", spaces="remove")


@query(
    "map_values",
    """
    select c_custkey, coalesce(case c_mktsegment when 'AUTOMOBILE' then 'AUTO'
                                                 when 'MACHINERY' then 'MACH' end,
                               c_mktsegment) as c_mktsegment
    from customer
    """,
)
def q_map_values(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ops.map_values(cust, "c_mktsegment", {"AUTOMOBILE": "AUTO", "MACHINERY": "MACH"})


@query(
    "map_values_table",
    """
    select o_orderkey, case when o_custkey % 2 = 0 then c_name else o_clerk end as o_clerk
    from (select o_orderkey, o_custkey, cast(o_custkey as varchar) as o_clerk from orders) o
    join customer on c_custkey = o_custkey
    """,
)
def q_map_values_table(spark, sf):
    """Customer keys as text, mapped to names by a table that writes odd keys another way."""
    key = F.col("c_custkey").cast("string")
    written = F.when(F.col("c_custkey") % 2 == 0, key).otherwise(F.concat(F.lit("no. "), key))
    names = table(spark, sf, "customer").select(written.alias("from"), F.col("c_name").alias("to"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_clerk"))
    return ops.map_values(orders, "o_clerk", names)


@query(
    "standardize_names",
    "select p_partkey, replace(lower(trim(p_name)), ' ', '_') as p_name_key, "
    "replace(lower(trim(p_type)), ' ', '_') as p_type_key from part",
)
def q_standardize_names(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("P Name Key"),
                                           F.col("p_type").alias(" P Type Key "))
    renamed = ops.standardize_names(part)
    return ops.standardize_values(renamed, ["p_name_key", "p_type_key"])


@query("drop_duplicates_rows", "select distinct text, lang, source from documents")
def q_drop_duplicates_rows(spark, sf):
    return ops.drop_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


@query("impute_constant", f"select event_id, coalesce(value, -1.0) as value from {EV0}")
def q_impute_constant(spark, sf):
    return ops.impute(events_with_gaps(spark, sf), "value", "constant", value=-1.0).select("event_id", "value")


@query(
    "impute_mean_by_group",
    f"select event_id, round(coalesce(value, avg(value) over (partition by user_id)), 6) as value from {EV0}",
)
def q_impute_mean_by_group(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "mean", by="user_id")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(
    "standardize_text_collapse",
    r"select p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) as p_name from part",
)
def q_standardize_text_collapse(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return ops.standardize_text(part, "p_name", case="lower", spaces="collapse")


# --- D: single-dataset transformations ----------------------------------------------------------


@query(
    "parse_time",
    """
    select event_id,
           try_strptime(case when event_id % 9 = 0 then 'bad'
                             else strftime(ts, '%Y-%m-%d %H:%M:%S') end,
                        '%Y-%m-%d %H:%M:%S') as t
    from events
    """,
)
def q_parse_time(spark, sf):
    ev = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ops.parse_time(ev.select("event_id", text.alias("t")), "t", "yyyy-MM-dd HH:mm:ss")


@query(
    "age_years",
    "select o_orderkey, date_sub('year', o_orderdate, timestamp '2002-01-01') as age from orders",
)
def q_age_years(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ops.years_between(orders, "o_orderdate", "2002-01-01 00:00:00", out="age").drop("o_orderdate")


@query(
    "split_column",
    "select p_partkey, nullif(split_part(p_name, ' ', 1), '') as p_1, "
    "nullif(split_part(p_name, ' ', 2), '') as p_2, nullif(split_part(p_name, ' ', 3), '') as p_3 "
    "from part",
)
def q_split_column(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return ops.split_column(part, "p_name", ["p_1", "p_2", "p_3"], drop=True)


@query(
    "moving_average",
    """
    select event_id,
           round(avg(value) over (partition by user_id order by ts, event_id
                                  rows between 2 preceding and current row), 6) as v
    from events
    """,
)
def q_moving_average(spark, sf):
    ev = table(spark, sf, "events")
    out = ops.smooth(ev, "value", "user_id", ["ts", "event_id"], window=3, out="v")
    return out.select("event_id", F.round("v", 6).alias("v"))


@query(
    "moving_average_window",
    """
    select event_id,
           round(avg(value) over (partition by user_id order by ts, event_id
                                  rows between 4 preceding and current row), 6) as v
    from events
    """,
)
def q_moving_average_window(spark, sf):
    ev = table(spark, sf, "events")
    out = ops.smooth(ev, "value", "user_id", ["ts", "event_id"], window=5, out="v", method="window")
    return out.select("event_id", F.round("v", 6).alias("v"))


@query(
    "drop_outliers_iqr",
    """
    with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
    select event_id, value from events, q
    where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)
    """,
)
def q_drop_outliers_iqr(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.drop_outliers(ev, "value", "iqr", 1.5)


@query(
    "drop_outliers_z",
    """
    with q as (select avg(value) as a, stddev_samp(value) as s from events)
    select event_id, value from events, q where value between a - 3 * s and a + 3 * s
    """,
)
def q_drop_outliers_z(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.drop_outliers(ev, "value", "zscore", 3.0)


@query(
    "aggregate",
    """
    select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty,
           round(avg(l_extendedprice), 4) as avg_price, min(l_discount) as min_disc,
           max(l_discount) as max_disc
    from lineitem group by l_returnflag, l_linestatus
    """,
)
def q_aggregate(spark, sf):
    li = table(spark, sf, "lineitem")
    return ops.aggregate(
        li,
        ["l_returnflag", "l_linestatus"],
        {
            "n": ("count", "*"),
            "sum_qty": F.round(F.sum("l_quantity"), 2),
            "avg_price": F.round(F.avg("l_extendedprice"), 4),
            "min_disc": ("min", "l_discount"),
            "max_disc": ("max", "l_discount"),
        },
    )


@query(
    "discretize_width",
    """
    with m as (select min(value) as lo, max(value) as hi from events)
    select event_id, least(cast(floor((value - lo) / (hi - lo) * 5) as bigint), 4) as bin
    from events, m
    """,
)
def q_discretize_width(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.discretize(ev, "value", "width", n=5).select("event_id", "bin")


@query(
    "discretize_quantile",
    """
    with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b,
                      quantile_cont(value, 0.75) as c from events)
    select event_id, cast((a < value)::int + (b < value)::int + (c < value)::int as bigint) as bin
    from events, q
    """,
)
def q_discretize_quantile(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.discretize(ev, "value", "quantile", n=4).select("event_id", "bin")


@query(
    "discretize_edges",
    """
    select event_id, cast((value > 10)::int + (value > 50)::int + (value > 100)::int as bigint) as bin
    from events
    """,
)
def q_discretize_edges(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.discretize(ev, "value", "edges", edges=[50, 10, 100]).select("event_id", "bin")


@query(
    "construct",
    "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem",
)
def q_construct(spark, sf):
    li = table(spark, sf, "lineitem")
    out = ops.construct(li, {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)})
    return out.select("l_orderkey", "l_linenumber", "net")


@query("reduce", "select doc_id, lang from documents where doc_id % 10 = 0")
def q_reduce(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ops.reduce_rows(docs, 0.1, "doc_id", method="modulo", modulus=10)


@query(
    "reduce_stratified",
    """
    select doc_id, lang from documents
    where cast('0x' || left(md5('7|' || doc_id), 5) as int) < 1048576 * case lang when 'en' then 0.5 else 0.25 end
    """,
)
def q_reduce_stratified(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    fractions = {"en": 0.5, "de": 0.25, "fr": 0.25, "es": 0.25}
    return ops.reduce_rows(docs, fractions, "doc_id", strata="lang", seed=7)


@query(
    "reduce_stratified_modulo",
    """
    select doc_id, lang from documents
    where (lang = 'en' and doc_id % 10 < 5) or (lang in ('de', 'fr', 'es') and doc_id % 10 < 2.5)
    """,
)
def q_reduce_stratified_modulo(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    fractions = {"en": 0.5, "de": 0.25, "fr": 0.25, "es": 0.25}
    return ops.reduce_rows(docs, fractions, "doc_id", strata="lang", method="modulo", modulus=10)


def _feature_sql() -> str:
    parts = []
    for f in ("l_quantity", "l_discount", "l_tax"):
        parts.append(
            f"select '{f}' as feature, round(var_samp({f}), 4) as variance, "
            f"round(corr({f}, l_extendedprice), 6) as corr, "
            f"1 - count({f}) / count(*) as null_share from lineitem"
        )
    return "\nunion all\n".join(parts)


@query("select_features", _feature_sql())
def q_select_features(spark, sf):
    li = table(spark, sf, "lineitem")
    scores = ops.feature_scores(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return scores.select(
        "feature", F.round("variance", 4).alias("variance"), F.round("corr", 6).alias("corr"), "null_share"
    )


@query(
    "scale",
    "select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) as z from events",
)
def q_scale(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    out = ops.extract_features(ev, ["value"], "scale")
    return out.select("event_id", F.round("value", 6).alias("z"))


@query(
    "minmax",
    """
    select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6)
           as scaled from events
    """,
)
def q_minmax(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    out = ops.extract_features(ev, ["value"], "minmax")
    return out.select("event_id", F.round("value", 6).alias("scaled"))


_PCA_SQL = """
with m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, var_samp(l_quantity) as a,
                  covar_samp(l_quantity, l_extendedprice) as b, var_samp(l_extendedprice) as c from lineitem),
t as (select *, 0.5 * atan2(2 * b, a - c) as angle from m),
s as (select *, case when abs(cos(angle)) >= abs(sin(angle)) then sign(cos(angle)) else sign(sin(angle)) end as s1,
             case when abs(sin(angle)) >= abs(cos(angle)) then sign(-sin(angle)) else sign(cos(angle)) end as s2
      from t)
select l_orderkey, l_linenumber,
       round(s1 * (cos(angle) * (l_quantity - mx) + sin(angle) * (l_extendedprice - my)), 3) as pc1,
       round(s2 * (-sin(angle) * (l_quantity - mx) + cos(angle) * (l_extendedprice - my)), 3) as pc2
from lineitem, s
"""


def _components(spark, sf, solver=None) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = ops.extract_features(li, ["l_quantity", "l_extendedprice"], "pca", k=2, solver=solver)
    return out.select(
        "l_orderkey", "l_linenumber", F.round(F.col("pca")[0], 3).alias("pc1"), F.round(F.col("pca")[1], 3).alias("pc2")
    )


@query("pca", _PCA_SQL)
def q_pca(spark, sf):
    """Two columns, whose components have a closed form."""
    return _components(spark, sf)


@query("pca_block", _PCA_SQL)
def q_pca_block(spark, sf):
    """The same by products with a block of vectors, as wide tables take it."""
    return _components(spark, sf, "block")


@query(
    "select_features_top",
    "select l_orderkey, l_linenumber, l_quantity, l_tax, l_extendedprice from lineitem",
)
def q_select_features_top(spark, sf):
    """The two features with the largest correlation to the price, and the price."""
    li = table(spark, sf, "lineitem").withColumn("l_tax", F.col("l_tax") + 0 * F.col("l_extendedprice"))
    li = li.withColumn("noise", F.lit(1.0))
    _, reduced = ops.select_features(
        li, ["l_quantity", "noise", "l_tax"], "l_extendedprice", top_k=2, keep=("l_orderkey", "l_linenumber")
    )
    return reduced


# --- E: several datasets ------------------------------------------------------------------------


def _join_sides(spark, sf):
    """All orders, and all customers under a key that leaves rows of both unmatched."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cust = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"), "c_name")
    return orders, cust


_JOIN_SQL = {
    "inner": "join", "left": "left join", "right": "right join", "full": "full join",
}

for _kind, _sql_kind in _JOIN_SQL.items():
    def _make(kind):
        def q(spark, sf):
            o, c = _join_sides(spark, sf)
            return ops.join_on_keys(o, c, "o_custkey", kind).select("o_orderkey", "o_custkey", "o_totalprice", "c_name")
        return q

    query(
        f"join_{_kind}",
        f"""
        select o.o_orderkey, coalesce(o.o_custkey, c.c_custkey) as o_custkey, o.o_totalprice, c.c_name
        from orders o
        {_sql_kind} (select c_custkey * 2 as c_custkey, c_name from customer) c on o.o_custkey = c.c_custkey
        """,
    )(_make(_kind))

query("join_full_split", ORACLE_SQL["join_full"])(
    lambda spark, sf: ops.join_on_keys(*_join_sides(spark, sf), "o_custkey", "full", split_full=True)
    .select("o_orderkey", "o_custkey", "o_totalprice", "c_name")
)

for _kind, _sql_kind in {"left_semi": "semi join", "left_anti": "anti join"}.items():
    def _make_semi(kind):
        def q(spark, sf):
            o, c = _join_sides(spark, sf)
            return ops.join_on_keys(o, c, "o_custkey", kind)
        return q

    query(
        f"join_{_kind}",
        f"""
        select o.o_orderkey, o.o_custkey, o.o_totalprice
        from orders o
        {_sql_kind} (select c_custkey * 2 as c_custkey, c_name from customer) c on o.o_custkey = c.c_custkey
        """,
    )(_make_semi(_kind))


def _band_sides(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return sup.alias("a"), sup.alias("b")


_BAND = "a.s_acctbal < b.s_acctbal and b.s_acctbal < a.s_acctbal + 100"


@query(
    "join_condition",
    f"select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a join supplier b on {_BAND}",
)
def q_join_condition(spark, sf):
    a, b = _band_sides(spark, sf)
    out = ops.join_on_condition(a, b, _BAND, "inner", band=("a.s_acctbal", "b.s_acctbal", 0.0, 100.0))
    return out.select(F.col("a.s_suppkey").alias("a_key"), F.col("b.s_suppkey").alias("b_key"))


@query(
    "join_condition_anti",
    f"select a.s_suppkey as a_key from supplier a anti join supplier b on {_BAND}",
)
def q_join_condition_anti(spark, sf):
    a, b = _band_sides(spark, sf)
    out = ops.join_on_condition(a, b, _BAND, "left_anti", band=("a.s_acctbal", "b.s_acctbal", 0.0, 100.0))
    return out.select(F.col("s_suppkey").alias("a_key"))


@query(
    "join_condition_left",
    f"select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a left join supplier b on {_BAND}",
)
def q_join_condition_left(spark, sf):
    a, b = _band_sides(spark, sf)
    out = ops.join_on_condition(a, b, _BAND, "left", band=("a.s_acctbal", "b.s_acctbal", 0.0, 100.0))
    return out.select(F.col("a.s_suppkey").alias("a_key"), F.col("b.s_suppkey").alias("b_key"))


_NEAR_NATION = "abs(c_nationkey - s_nationkey) <= 1 and s_acctbal > c_acctbal + 9000"

for _kind, _sql_kind in {"inner": "join", "left": "left join", "left_semi": "semi join", "full": "full join"}.items():
    def _make_tiles(kind):
        def q(spark, sf):
            """25 values share out all rows: every bucket is hot."""
            c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
            s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
            band = ("c_nationkey", "s_nationkey", -1, 1)
            out = ops.join_on_condition(c, s, _NEAR_NATION, kind, band=band, tile_rows=100)
            return out.select("c_custkey", *(["s_suppkey"] if kind != "left_semi" else []))
        return q

    query(
        f"join_band_hot_{_kind}",
        f"select c_custkey{', s_suppkey' if _kind != 'left_semi' else ''} "
        f"from customer {_sql_kind} supplier on {_NEAR_NATION}",
    )(_make_tiles(_kind))


@query(
    "semi_join_inequality",
    """
    select c_custkey, c_acctbal from customer
    where exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal - 9000 > c_acctbal)
    """,
)
def q_semi_join_inequality(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 9000).alias("least"))
    return ops.join_on_inequality(c, s, ("c_acctbal", "<", "least"), on="nation").drop("nation")


@query(
    "anti_join_inequality",
    """
    select l_orderkey, l_linenumber, l_extendedprice from lineitem
    where not exists (select 1 from part where p_retailprice * 40 <= l_extendedprice)
    """,
)
def q_anti_join_inequality(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    parts = table(spark, sf, "part").select((F.col("p_retailprice") * 40).alias("price"))
    return ops.join_on_inequality(lines, parts, ("l_extendedprice", ">=", "price"), how="left_anti")


_DECIMAL_BAND = "b_bal >= a_bal and b_bal <= a_bal + 0.1"


def _decimal_band_sides(spark, sf):
    """Customers and suppliers by balance to one decimal; the band's edge is hit often."""
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("a_key"), F.round("c_acctbal", 1).cast("decimal(12,1)").alias("a_bal")
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("b_key"), F.round("s_acctbal", 1).cast("decimal(12,1)").alias("b_bal")
    )
    return a, b


for _kind, _sql_kind in {"inner": "join", "right": "right join", "full": "full join"}.items():
    def _make_band(kind):
        def q(spark, sf):
            a, b = _decimal_band_sides(spark, sf)
            out = ops.join_on_condition(a, b, _DECIMAL_BAND, kind, band=("a_bal", "b_bal", 0, 0.1))
            return out.select("a_key", "b_key")
        return q

    query(
        f"join_band_{_kind}",
        f"""
        select a.a_key, b.b_key
        from (select c_custkey as a_key, cast(round(c_acctbal, 1) as decimal(12,1)) as a_bal from customer) a
        {_sql_kind} (select s_suppkey as b_key, cast(round(s_acctbal, 1) as decimal(12,1)) as b_bal from supplier) b
        on {_DECIMAL_BAND}
        """,
    )(_make_band(_kind))


@query(
    "merge_records",
    """
    with d as (select case when doc_id % 3 <> 0 then doc_id end as doc_id,
                      case when doc_id % 2 = 0 then lang end as lang, source from documents),
    l as (select case when doc_id % 5 <> 0 then doc_id end as doc_id, 'label' as lang, quality, toxic from labels)
    select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(d.lang, l.lang) as lang, d.source,
           coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic
    from d full join l on d.doc_id = l.doc_id
    """,
)
def q_merge_records(spark, sf):
    """Two tables that share a column besides the key, some keys null on either side."""
    docs = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"),
        "source",
    )
    labels = table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("doc_id"),
        F.lit("label").alias("lang"), "quality", "toxic",
    )
    merged = ops.integrate({"documents": docs, "labels": labels}, "doc_id")
    return merged.select(
        "doc_id", "lang", "source",
        F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"),
    )


@query(
    "union",
    "select c_name as name, c_acctbal as bal from customer union all select s_name, s_acctbal from supplier",
)
def q_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return ops.union([c, s])


@query(
    "union_distinct",
    "select n_regionkey as regionkey from nation union select r_regionkey from region",
)
def q_union_distinct(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("regionkey"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"))
    return ops.union([n, r], distinct=True)


# --- F: SQL models -----------------------------------------------------------------------------------

# (Spark SQL, DuckDB SQL); {name} is a source DataFrame in Spark and a view in DuckDB.
MODELS = {
    "sql_rank": (
        "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey "
        "order by o_totalprice desc, o_orderkey) as bigint) as rn from {orders}",
        None,
    ),
    "sql_cube": (
        "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as int) as g_flag, "
        "cast(grouping(l_linestatus) as int) as g_status, count(*) as n, "
        "round(sum(l_quantity), 2) as qty from {lineitem} group by cube(l_returnflag, l_linestatus)",
        None,
    ),
    "sql_setops": (
        "select o_custkey as custkey from {orders} where o_orderpriority = '1-URGENT' "
        "intersect select o_custkey from {orders} where o_orderstatus = 'F'",
        None,
    ),
    "sql_except": (
        "select c_custkey as custkey from {customer} where c_mktsegment = 'BUILDING' "
        "except select o_custkey from {orders} where o_orderpriority = '1-URGENT'",
        None,
    ),
    "sql_topk": (
        "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20",
        None,
    ),
    "sql_json": (
        "select event_id, cast(get_json_object(props, '$.k') as bigint) as k from {events}",
        "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    ),
    "sql_array": (
        "select vec_id, round(aggregate(transform(embedding, x -> cast(x as double) * x), "
        "cast(0 as double), (acc, y) -> acc + y), 4) as sq from {embeddings}",
        "select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 4) "
        "as sq from embeddings",
    ),
}


def _model_query(name: str, spark_sql: str):
    def q(spark, sf):
        used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in spark_sql}
        return run_model(spark, f"bp_{name}", spark_sql, sources=used, materialized="view")

    return q


for _name, (_spark_sql, _duck_sql) in MODELS.items():
    _oracle = _duck_sql
    if _oracle is None:
        _oracle = _spark_sql
        for _t in TABLES:
            _oracle = _oracle.replace("{" + _t + "}", _t)
    query(_name, _oracle)(_model_query(_name, _spark_sql))


MODEL_SCHEMA = "bp_models"


def _model_schema(spark) -> str:
    """A catalog database stored in the shared scratch folder."""
    ensure_database(spark, MODEL_SCHEMA, scratch_path(spark, "models"))
    return MODEL_SCHEMA


@query(
    "sql_model_table",
    "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total "
    "from orders group by o_orderstatus, o_orderpriority",
)
def q_sql_model_table(spark, sf):
    schema = _model_schema(spark)
    sql = (
        "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total "
        "from {orders} group by o_orderstatus, o_orderpriority"
    )
    run_model(
        spark, "order_totals", sql, sources={"orders": table(spark, sf, "orders")}, materialized="table",
        schema=schema, comments={"total": "sum of order prices, rounded to cents"},
    )
    return read_model(spark, "order_totals", schema)


# --- G: user functions -------------------------------------------------------------------------------


@query("run_block_column", "select o_orderkey * 2 as double_key from orders")
def q_run_block_column(spark, sf):
    def doubled(df=None):
        return (F.col("o_orderkey") * 2).alias("double_key")

    return run_block(doubled, df=table(spark, sf, "orders"))


@query(
    "pandas_block_keyed",
    """
    with c as (select event_id, user_id, cast(round(value * 100) as bigint) as cents from events)
    select event_id, user_id,
           cast(cents * count(*) over w - sum(cents) over w as bigint) as spread from c
    window w as (partition by user_id)
    """,
)
def q_pandas_block_keyed(spark, sf):
    """A user's whole group in one pandas call: each value against the group's mean, in exact cents."""
    def spread(pdf):
        cents = (pdf["value"] * 100).round().astype("int64")
        return pdf[["event_id", "user_id"]].assign(spread=cents * len(pdf) - cents.sum())

    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return pandas_block(ev, spread, "event_id bigint, user_id bigint, spread bigint", keys=["user_id"])


@query(
    "pandas_block",
    "select event_id, cast(round(value * 100) as bigint) as value_cents from events",
)
def q_pandas_block(spark, sf):
    # defined inside, so it is shipped to the Python workers by value
    def value_cents(pdf):
        out = pdf[["event_id"]].copy()
        out["value_cents"] = (pdf["value"] * 100).round().astype("int64")
        return out

    ev = table(spark, sf, "events").select("event_id", "value")
    return pandas_block(ev, value_cents, "event_id bigint, value_cents bigint")


# --- H2: lineage over a block table derived from conversations ---------------------------------------

_CONV_BLOCKS = """
    select cast(conv_id as string) as project,
           case when role = 'user' then 1 else 2 end as section_pos,
           case role when 'user' then 'Cleaning' when 'assistant' then 'Transformation'
                     else 'Orchestration' end as section_type,
           cast(turn as int) as block_pos,
           'b' || cast(turn as string) as block,
           true as has_setup,
           length(text) > 40 as has_code,
           case when turn > 0 then 's' end as source_section,
           case when turn % 2 = 1 then 'b' || cast(turn - 1 as string)
                when turn >= 2 then 'b' || cast(turn - 2 as string) end as source_block
    from conversations
"""


@query(
    "block_adjacency",
    f"""
    with b as ({_CONV_BLOCKS}),
    nodes as (select * from b where lower(section_type) <> 'orchestration' and has_setup and has_code),
    e as (select project, source_block as block, block as child, section_pos, block_pos from nodes
          where coalesce(source_section, '') <> '' and coalesce(source_block, '') <> ''),
    k as (select project, block from nodes union select project, block from e)
    select k.project, k.block,
           coalesce(string_agg(e.child, ',' order by e.section_pos, e.block_pos, e.child), '') as children
    from k left join e on k.project = e.project and k.block = e.block
    group by k.project, k.block
    """,
)
def q_block_adjacency(spark, sf):
    conv = table(spark, sf, "conversations")
    blocks = spark.sql(_CONV_BLOCKS.replace("from conversations", "from {conversations}"), conversations=conv)
    adj = block_adjacency(blocks)
    return adj.select("project", "block", F.array_join("adj", ",").alias("children"))


# --- the skew-safe ranked plans, forced, on the same SQL -----------------------------------------------
# (the queries above use method="auto", which picks the simple plans at these
# sizes; these run the plans used when a group is too big for one task)


@query("moving_average_ranked", ORACLE_SQL["moving_average"])
def q_moving_average_ranked(spark, sf):
    ev = table(spark, sf, "events")
    out = ops.smooth(ev, "value", "user_id", ["ts", "event_id"], window=3, out="v", method="ranked")
    return out.select("event_id", F.round("v", 6).alias("v"))


@query("impute_median_by_group_ranked", ORACLE_SQL["impute_median_by_group"])
def q_impute_median_by_group_ranked(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "median", by="event_type", quantile_method="ranked")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("drop_outliers_iqr_ranked", ORACLE_SQL["drop_outliers_iqr"])
def q_drop_outliers_iqr_ranked(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.drop_outliers(ev, "value", "iqr", 1.5, quantile_method="ranked")


@query("discretize_quantile_ranked", ORACLE_SQL["discretize_quantile"])
def q_discretize_quantile_ranked(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.discretize(ev, "value", "quantile", n=4, quantile_method="ranked").select("event_id", "bin")


@query("impute_median_by_group_narrowed", ORACLE_SQL["impute_median_by_group"])
def q_impute_median_by_group_narrowed(spark, sf):
    out = ops.impute(events_with_gaps(spark, sf), "value", "median", by="event_type", quantile_method="narrowed")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("drop_outliers_iqr_narrowed", ORACLE_SQL["drop_outliers_iqr"])
def q_drop_outliers_iqr_narrowed(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.drop_outliers(ev, "value", "iqr", 1.5, quantile_method="narrowed")


@query("discretize_quantile_narrowed", ORACLE_SQL["discretize_quantile"])
def q_discretize_quantile_narrowed(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return ops.discretize(ev, "value", "quantile", n=4, quantile_method="narrowed").select("event_id", "bin")


# --- C6: formats and variants found in values; D9: samples of an exact size ------------------------------

# Customers' segments, some of them in other spellings or by their initials.
_SEGMENTS = """
    select c_custkey, c_nationkey, case c_custkey % 12
      when 0 then lower(c_mktsegment || ' market of goods')
      when 1 then 'MARKET OF GOODS, ' || c_mktsegment
      when 2 then left(c_mktsegment, 1) || 'MG'
      when 3 then left(c_mktsegment, 1) || '.M.G.'
      when 4 then null
      else c_mktsegment || ' MARKET OF GOODS' end as segment
    from customer"""
_VARIANTS = f"""
    seg as ({_SEGMENTS}),
    val as (select segment as v, count(*) as n, trim(regexp_replace(lower(segment), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as t
            from seg where segment is not null group by segment),
    keyed as (select *, case when regexp_matches(t, '^\\S( \\S)+$') then replace(t, ' ', '')
                             else array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ') end as k
              from val where t <> ''),
    best as (select * from keyed qualify row_number() over (partition by k order by n desc, v) = 1),
    firsts as (
      select distinct b.k as long_k, b.v as long_v, b.n as long_n, w.i
      from best b, lateral (select unnest([
        array_to_string([x[1] for x in string_split(b.t, ' ')], ''),
        array_to_string([x[1] for x in string_split(b.t, ' ')
                         if x not in ('a', 'and', 'de', 'for', 'in', 'of', 'on', 'the', 'to')], '')]) as i) w
      where contains(b.t, ' ') and not regexp_matches(b.t, '^\\S( \\S)+$') and length(w.i) > 1),
    alone as (select i, any_value(long_v) as long_v, any_value(long_n) as long_n from firsts group by i having count(*) = 1),
    variants as (
      select * from (
        select c.v as value, coalesce(a.long_v, b.v) as target, c.n, coalesce(a.long_n, b.n) as target_n,
               case when a.i is null then 'spelling' else 'initials' end as rule
        from keyed c join best b using (k)
        left join alone a on a.i = b.k and regexp_matches(b.k, '^\\p{{L}}{{2,}}$') and b.v = upper(b.v))
      where value <> target)"""


def _segments(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_bp_segments_customer")
    return spark.sql(_SEGMENTS.replace("from customer", "from _bp_segments_customer"))


@query("value_variants", f"with {_VARIANTS} select * from variants")
def q_value_variants(spark, sf):
    return ops.value_variants(_segments(spark, sf), "segment")


@query(
    "map_found_variants",
    f"""
    with {_VARIANTS}
    select c_custkey, coalesce(target, segment) as segment from seg left join variants on segment = value
    """,
)
def q_map_found_variants(spark, sf):
    segments = _segments(spark, sf)
    found = ops.value_variants(segments, "segment")
    return ops.map_values(segments, "segment", found).select("c_custkey", "segment")


@query(
    "value_patterns",
    """
    with val as (select 'name' as column_name, c_name as v from customer union all
                 select 'segment', c_mktsegment from customer union all
                 select 'date', o from (select case when c_custkey % 3 = 0 then c_custkey || '/05/2020'
                                                    else '2020-05-' || c_custkey end as o from customer)),
    pat as (select column_name, v, regexp_replace(regexp_replace(regexp_replace(
              v, '\\p{Ll}+', 'a', 'g'), '\\p{Lu}+', 'A', 'g'), '[0-9]+', '9', 'g') as pattern
            from val where v is not null)
    select column_name, pattern, count(*) as n,
           round(count(*) / sum(count(*)) over (partition by column_name), 9) as share, min(v) as example
    from pat group by column_name, pattern
    """,
)
def q_value_patterns(spark, sf):
    number = F.col("c_custkey").cast("string")
    date = F.when(F.col("c_custkey") % 3 == 0, F.concat(number, F.lit("/05/2020"))).otherwise(F.concat(F.lit("2020-05-"), number))
    values = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), date.alias("date"))
    return ops.value_patterns(values, ["name", "segment", "date"]).withColumn("share", F.round("share", 9))


@query(
    "sample_strata",
    """
    with p as (select doc_id, lang, (cast('0x' || left(md5('5|' || doc_id), 13) as bigint) + 0.5) / 4503599627370496.0 as p
               from documents)
    select doc_id, lang, round(greatest(count(*) over (partition by lang) / 30.0, 1), 6) as inclusion_weight
    from p qualify row_number() over (partition by lang order by p) <= 30
    """,
)
def q_sample_strata(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ops.sample_rows(docs, 30, "doc_id", "lang", seed=5).withColumn(
        "inclusion_weight", F.round("inclusion_weight", 6)
    )


@query(
    "sample_weighted",
    """
    with p as (select o_orderkey, o_orderpriority, o_totalprice, -ln(
                 (cast('0x' || left(md5('9|' || o_orderkey), 13) as bigint) + 0.5) / 4503599627370496.0) / o_totalprice as p
               from orders),
    r as (select *, row_number() over w as r, count(*) over (partition by o_orderpriority) as n,
                 nth_value(p, 101) over (w rows between unbounded preceding and unbounded following) as t
          from p window w as (partition by o_orderpriority order by p))
    select o_orderkey, o_orderpriority, o_totalprice,
           round(case when n <= 100 then 1.0 else 1 / (1 - exp(-o_totalprice * t)) end, 4) as stands_for
    from r where r <= 100
    """,
)
def q_sample_weighted(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    found = ops.sample_rows(orders, 100, "o_orderkey", "o_orderpriority", "o_totalprice", seed=9, out="stands_for")
    return found.withColumn("stands_for", F.round("stands_for", 4))


_LINE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")


def _information_sql() -> str:
    numbers = [c for c in _LINE_FEATURES if c != "l_returnflag"]
    steps = [
        f"least(cast(floor(({c} - (select min({c}) from lineitem)) / "
        f"((select max({c}) from lineitem) - (select min({c}) from lineitem)) * 8) as int), 7) as {c}" for c in numbers
    ]
    binned = ", ".join([*steps, "cast('0x' || left(md5(l_returnflag), 8) as bigint) % 8 as l_returnflag"])
    pairs = [(a, b) for i, a in enumerate(_LINE_FEATURES) for b in _LINE_FEATURES[i:]]
    counts = " union all ".join(
        f"select '{a}' as a, '{b}' as b, {a} as x, {b} as y, count(*) as n from binned group by {', '.join({a: 1, b: 1})}"
        for a, b in pairs
    )
    return f"""
    with binned as (select {binned} from lineitem), counts as ({counts}),
    parts as (select a, b, n / sum(n) over w as share,
                     n * sum(n) over w / (sum(n) over (partition by a, b, x) * sum(n) over (partition by a, b, y)) as lift
              from counts window w as (partition by a, b))
    select a, b, round(sum(share * ln(lift)), 9) as information from parts group by a, b"""


@query("mutual_information", _information_sql())
def q_mutual_information(spark, sf):
    lines = table(spark, sf, "lineitem").select(*_LINE_FEATURES)
    return ops.mutual_information(lines, _LINE_FEATURES, bins=8).withColumn("information", F.round("information", 9))


@query(
    "select_informative",
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem",
)
def q_select_informative(spark, sf):
    """A feature and its copy in another unit: one of them stays."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    lines = lines.withColumn("dozens", F.col("l_quantity") / 12)
    keep = ["l_orderkey", "l_linenumber"]
    return ops.select_informative(lines, ["l_quantity", "dozens"], "l_extendedprice", top_k=2, keep=keep)[1]


# --- A: sources, sinks, movement ------------------------------------------------------------------------


@query("read_tables", "select n.*, r.r_name from nation n join region r on n_regionkey = r_regionkey")
def q_read_tables(spark, sf):
    paths = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("nation", "region", "missing_table")]
    dfs = io.read_tables(spark, paths, fmt="parquet")
    return ops.join_on_keys(dfs["nation"], dfs["region"].withColumnRenamed("r_regionkey", "n_regionkey"),
                            "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query(
    "normalize_dates",
    "select o_orderkey, cast(cast(o_orderdate as date) as timestamp) as o_orderdate from orders",
)
def q_normalize_dates(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return io.normalize_dates(orders)


@query("snapshot_roundtrip", "select * from orders")
def q_snapshot_roundtrip(spark, sf):
    where = scratch_path(spark, "snapshot")
    io.save_snapshot({"orders": table(spark, sf, "orders"), "part": table(spark, sf, "part")}, where)
    return io.load_snapshot(spark, where)["orders"]


@query("convert_csv", "select * from lineitem")
def q_convert_csv(spark, sf):
    dst = scratch_path(spark, "lineitem_csv")
    return io.convert_files(spark, f"{sf.rstrip('/')}/lineitem.parquet", "parquet", dst, "csv")


@query("convert_csv_text", "select * from documents")
def q_convert_csv_text(spark, sf):
    """Texts with line breaks, quotes and blanks at the ends, to CSV files and back."""
    dst = scratch_path(spark, "documents_csv")
    return io.convert_files(spark, f"{sf.rstrip('/')}/documents.parquet", "parquet", dst, "csv")


@query("move_csv", "select * from documents")
def q_move_csv(spark, sf):
    dst = scratch_path(spark, "documents_moved")
    return io.move(spark, table(spark, sf, "documents"), dst, destination_fmt="csv")


@query("export_csv_text", "select * from documents")
def q_export_csv_text(spark, sf):
    docs = table(spark, sf, "documents")
    return io.read_export(spark, io.export_csv(docs, scratch_path(spark, "documents_export")), docs.schema)


@query("read_csv", "select * from customer")
def q_read_csv(spark, sf):
    """A table written as CSV and read with a given schema."""
    cust = table(spark, sf, "customer")
    path = io.write_files(cust, scratch_path(spark, "customer_csv"), "csv")
    return io.read_csv(spark, path, schema=cust.schema)


@query("read_csv_documents", "select * from documents")
def q_read_csv_documents(spark, sf):
    """Texts with quotes and line breaks, written as CSV and read with the defaults."""
    docs = table(spark, sf, "documents")
    path = io.write_files(docs, scratch_path(spark, "documents_csv"), "csv")
    return io.read_csv(spark, path, schema=docs.schema)


@query("move_json", "select * from customer")
def q_move_json(spark, sf):
    dst = scratch_path(spark, "customer_json")
    return io.move(spark, table(spark, sf, "customer"), dst, destination_fmt="json")


@query("move_table", "select * from customer")
def q_move_table(spark, sf):
    schema = _model_schema(spark)
    io.move(spark, table(spark, sf, "customer"), f"{schema}.customer_copy")
    return io.read_table(spark, f"{schema}.customer_copy")


@query("export_csv", "select * from part")
def q_export_csv(spark, sf):
    part = table(spark, sf, "part")
    dst = io.export_csv(part, scratch_path(spark, "part_export"))
    return io.read_export(spark, dst, part.schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
