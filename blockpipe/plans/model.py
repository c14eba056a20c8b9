"""SQL models (F1, F2): one SELECT over named sources, published as a view or table.

A model's SQL may use anything Spark SQL supports (joins, grouping sets,
windows, set operations, JSON, array and map functions). Sources are either
catalog tables, referenced as ``{{ source('schema', 'table') }}`` or by name,
or DataFrames (or catalog table names) passed in ``sources`` and referenced as
``{name}`` (Spark's own DataFrame parameters of ``spark.sql``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_SOURCE_REF = re.compile(r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*['\"]([^'\"]+)['\"]\s*)?\)\s*\}\}")
# Fixed value: the schema of models and sources that name none.
DEFAULT_SCHEMA = "main"


class ModelError(RuntimeError):
    """A model failed; the message is the engine's."""


def _quote(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def resolve_sources(sql: str) -> str:
    """``{{ source('s', 't') }}`` becomes the catalog name `s`.`t`, and
    ``{{ source('t') }}`` that of `t` in the default schema."""
    def name(m):
        schema, table = (m.group(1), m.group(2)) if m.group(2) else (DEFAULT_SCHEMA, m.group(1))
        return f"{_quote(schema)}.{_quote(table)}"

    return _SOURCE_REF.sub(name, sql)


def _only_named(sql: str, names: Sequence[str]) -> str:
    """Braces that are no ``{name}`` of a given source, doubled: they are text."""
    named = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    parts = re.split(rf"(\{{(?:{named})\}})", sql) if named else [sql]
    return "".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))


def run_model(
    spark: SparkSession,
    name: str,
    sql: str,
    sources: Mapping[str, DataFrame | str] | None = None,
    materialized: str = "view",
    schema: str | None = None,
    comments: Mapping[str, str] | None = None,
    table_comment: str | None = None,
    location: str | None = None,
    source_comments: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Run the model and publish it; return the published relation.

    ``materialized="view"``: a temporary view ``name`` without ``schema``, a
    catalog view ``schema.name`` with one (its sources must then be catalog
    tables). ``"table"``: written as table ``schema.name`` (default schema
    ``main``), replacing an earlier run. ``comments`` maps column names to
    descriptions, stored as column comments; ``source_comments`` describes the
    columns of sources (``{source: {column: text}}``), and a model's columns that are
    a source's unchanged keep its description unless they have their own. A schema that does not exist yet
    is created, at ``location`` when given (a shared folder).
    """
    if materialized not in ("view", "table"):
        raise ValueError(f"materialized must be 'view' or 'table', got {materialized!r}")
    text = resolve_sources(sql)
    try:
        frames = {k: spark.table(v) if isinstance(v, str) else v for k, v in (sources or {}).items()}
        for k, notes in (source_comments or {}).items():
            for col, note in notes.items():
                known = frames[k].schema[col].metadata
                frames[k] = frames[k].withMetadata(col, {**known, "comment": note})
        df = spark.sql(_only_named(text, list(frames)), **frames) if frames else spark.sql(text)
        for col, note in (comments or {}).items():
            df = df.withMetadata(col, {**df.schema[col].metadata, "comment": note})
        if materialized == "view" and schema is None:
            df.createOrReplaceTempView(name)
            return spark.table(_quote(name))
        target = f"{_quote(schema or DEFAULT_SCHEMA)}.{_quote(name)}"
        ensure_database(spark, schema or DEFAULT_SCHEMA, location)
        if materialized == "view":
            if sources:
                raise ModelError("a catalog view needs catalog sources, not DataFrames")
            cols = ""
            if comments:
                parts = []
                for f in df.schema.fields:
                    note = (comments or {}).get(f.name)
                    parts.append(f"`{f.name}`" + (f" COMMENT '{_escape(note)}'" if note else ""))
                cols = f" ({', '.join(parts)})"
            note = f" COMMENT '{_escape(table_comment)}'" if table_comment else ""
            spark.sql(f"CREATE OR REPLACE VIEW {target}{cols}{note} AS {text}")
        else:
            df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(target)
            for col, note in (comments or {}).items():
                spark.sql(f"ALTER TABLE {target} ALTER COLUMN `{col}` COMMENT '{_escape(note)}'")
            if table_comment:
                spark.sql(f"COMMENT ON TABLE {target} IS '{_escape(table_comment)}'")
        return spark.table(target)
    except ModelError:
        raise
    except PySparkException as exc:
        raise ModelError(str(exc)) from exc


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the catalog database ``name`` unless it exists."""
    where = f" LOCATION '{_escape(location)}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quote(name)}{where}")


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def read_model(spark: SparkSession, model: str, schema: str | None = None) -> DataFrame:
    """The relation a model published: ``schema.model``, or the temp view."""
    return spark.table(f"{_quote(schema)}.{_quote(model)}" if schema else _quote(model))
