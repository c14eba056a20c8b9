"""Column expressions shared by the operators (all JVM-side built-ins)."""

from blockpipe.functions.columns import (
    as_column,
    is_fractional,
    is_missing,
    present,
    quoted,
    standardize_name,
    strip_whitespace,
)

__all__ = [
    "as_column",
    "is_fractional",
    "is_missing",
    "present",
    "quoted",
    "standardize_name",
    "strip_whitespace",
]
