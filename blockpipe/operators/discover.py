"""Formats and variants found in the values of text columns (for B5 and C6): which
patterns a column's values have, and which values are spellings or abbreviations of
another one, as a mapping for ``map_values``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockpipe.functions import quoted
from blockpipe.plans.ranking import null_safe_join

# Words that abbreviations may leave out.
SMALL_WORDS = ("a", "and", "de", "for", "in", "of", "on", "the", "to")


def value_patterns(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """``(column_name, pattern, n, share, example)``: how the values of text columns are
    built, most frequent pattern first in each column's counts.

    A pattern is the value with each run of lower-case letters as ``a``, of upper-case
    letters as ``A`` and of ASCII digits as ``9``; all else stays. ``share`` is of the column's
    values that are not null, ``example`` the smallest value. All columns are counted in one
    scan with map-side combine; a column of long free texts has a pattern for nearly
    every text, so name only the columns meant to have a format.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("v")) for c in cols])
    values = df.select(F.inline(pairs)).where("v is not null")
    # equal values first, so that patterns are made of distinct values only
    values = values.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    pattern = F.col("v")
    for kind, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), ("[0-9]+", "9")):
        pattern = F.regexp_replace(pattern, kind, sign)
    found = values.groupBy("column_name", pattern.alias("pattern")).agg(
        F.sum("n").alias("n"), F.min("v").alias("example")
    )
    totals = found.groupBy("column_name").agg(F.sum("n").alias("_bp_all"))  # a row a column
    found = found.join(F.broadcast(totals), "column_name")
    return found.select("column_name", "pattern", "n", (F.col("n") / F.col("_bp_all")).alias("share"), "example")


def _normal(value: Column) -> Column:
    """Lower-case words of letters and digits, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def value_variants(df: DataFrame, col: str, by: Sequence[str] | str = ()) -> DataFrame:
    """``(value, target, n, target_n, rule)``: values of a text column that stand for
    another one, with how often either occurs; its first two columns are a mapping
    for ``map_values``. Values without variants have no row.

    ``rule`` ``spelling``: values with the same words, whatever their case,
    punctuation, order and repetition; single letters are one word (``U.S.A.``, ``USA``). The
    target is the most frequent of them (ties: the smallest). ``initials``: a group whose
    target is one word of two or more letters, all upper-case, made of the first
    letters of exactly one other group's words (with or without ``SMALL_WORDS``); that group's
    target is taken. Nulls, and values without a letter or digit, take no part.

    With ``by``, values are compared within the groups of these columns, which then come
    first. Only counted distinct values are shuffled, by their words; a group of variants
    is a fixed-size buffer, however many it has.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = [quoted(k) for k in by]
    counts = df.where(quoted(col).isNotNull()).groupBy(*keys, quoted(col).cast("string").alias("_bp_v"))
    counts = counts.agg(F.count(F.lit(1)).alias("_bp_n")).withColumn("_bp_t", _normal(F.col("_bp_v")))
    text = F.col("_bp_t")
    single = text.rlike(r"^\S( \S)+$")
    sorted_words = F.array_join(F.array_sort(F.array_distinct(F.split(text, " "))), " ")
    key = F.when(single, F.replace(text, F.lit(" "), F.lit(""))).otherwise(sorted_words)
    counts = counts.where(text != "").withColumn("_bp_k", key)
    best = F.min(F.struct((-F.col("_bp_n")).alias("n"), F.col("_bp_v").alias("v"), F.col("_bp_t").alias("t")))
    groups = counts.groupBy(*keys, "_bp_k").agg(best.alias("_bp_b"))
    groups = groups.select(
        *keys, "_bp_k", F.col("_bp_b.v").alias("_bp_to"), (-F.col("_bp_b.n")).alias("_bp_ton"), F.col("_bp_b.t").alias("_bp_t")
    )

    words = F.split("_bp_t", " ")
    large = F.filter(words, lambda w: ~w.isin(*SMALL_WORDS))
    first = [F.array_join(F.transform(x, lambda w: F.substring(w, 1, 1)), "") for x in (words, large)]
    long = groups.where(text.contains(" ") & ~single)
    long = long.withColumn("_bp_k", F.explode(F.array_distinct(F.array(*first)))).where(F.length("_bp_k") > 1)
    long = long.groupBy(*keys, "_bp_k").agg(
        F.count(F.lit(1)).alias("_bp_c"), F.any_value("_bp_to").alias("_bp_long"), F.any_value("_bp_ton").alias("_bp_longn")
    )
    short = F.col("_bp_k").rlike(r"^\p{L}{2,}$") & (F.col("_bp_to") == F.upper("_bp_to"))
    targets = null_safe_join(groups.drop("_bp_t"), long.where("_bp_c = 1").drop("_bp_c"), [*by, "_bp_k"], "left")
    is_short = short & F.col("_bp_long").isNotNull()
    targets = targets.select(
        *keys, "_bp_k",
        F.when(is_short, F.col("_bp_long")).otherwise(F.col("_bp_to")).alias("_bp_to"),
        F.when(is_short, F.col("_bp_longn")).otherwise(F.col("_bp_ton")).alias("_bp_ton"),
        F.when(is_short, "initials").otherwise("spelling").alias("_bp_rule"),
    )
    out = null_safe_join(counts, targets, [*by, "_bp_k"], "inner").where(F.col("_bp_v") != F.col("_bp_to"))
    names = {"_bp_v": "value", "_bp_to": "target", "_bp_n": "n", "_bp_ton": "target_n", "_bp_rule": "rule"}
    return out.select(*keys, *[F.col(c).alias(name) for c, name in names.items()])
