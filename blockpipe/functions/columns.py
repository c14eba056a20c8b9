"""Small expression builders.

pandas treats None, NaN and NaT alike as "missing"; Spark keeps NaN as a value
of float columns. ``is_missing`` gives the pandas meaning as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType


# Lossless text formats for timestamps written as text.
TEXT_TIME_OPTS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """The column with exactly this name (dots and blanks are not nesting)."""
    return F.col(in_backticks(name))


def in_backticks(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_fractional(dtype: DataType) -> bool:
    return isinstance(dtype, (DoubleType, FloatType))


def is_missing(df: DataFrame, name: str) -> Column:
    """True where ``name`` is null, or NaN for float/double columns."""
    c = quoted(name)
    if is_fractional(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column's value, with NaN turned into null (so aggregates skip it)."""
    c = quoted(name)
    if is_fractional(df.schema[name].dataType):
        return F.when(~F.isnan(c), c)
    return c


def strip_whitespace(c: str | Column) -> Column:
    """Strip leading and trailing whitespace of any kind (Spark ``trim`` only strips blanks)."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def standardize_name(c: str | Column) -> Column:
    """Trim, lower-case and turn blanks into underscores, as a value expression."""
    return F.replace(F.lower(strip_whitespace(c)), F.lit(" "), F.lit("_"))
