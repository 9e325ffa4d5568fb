"""Fields from text by a catalog of patterns with confidence tiers, in one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(text: Column, pattern: str) -> Column:
    """First match of a pattern (its first group, if it has one); null without a match."""
    group = 1 if "(" in pattern.replace("(?i", "").replace("\\(", "").replace("(?:", "") else 0
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_wide(docs: DataFrame, catalog: Sequence[tuple[str, str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, *(field(F.col(text_col), p).alias(n) for n, p, _ in catalog))


def extract_long(docs: DataFrame, catalog: Sequence[tuple[str, str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, field, value, tier): a row per field found."""
    found = F.array(*(F.struct(F.lit(n).alias("field"), field(F.col(text_col), p).alias("value"), F.lit(t).alias("tier")) for n, p, t in catalog))
    return docs.select(id_col, F.explode(found).alias("f")).select(id_col, "f.*").where("value is not null")


def latest_date(text: Column, pattern: str) -> Column:
    """The latest of all dates (first group, DD/MM/YYYY) that a pattern finds."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda d: F.try_to_date(d, "dd/MM/yyyy")))


def mode_value(text: Column, pattern: str, low: float, high: float) -> Column:
    """The most frequent amount between two bounds, of equally frequent ones the first."""
    money = lambda v: F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), money), lambda v: (v >= low) & (v <= high))
    counted = F.transform(F.array_distinct(found), lambda v: F.struct(F.size(F.filter(found, lambda x: x == v)).alias("n"), (-F.array_position(found, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]


def priority_label(text: Column, catalog: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern of a catalog that a text holds."""
    return F.coalesce(*(F.when(text.rlike(p), label) for p, label in catalog))


def merge_by_tier(first: DataFrame, second: DataFrame, id_col: str, columns: Sequence[str], over: Sequence[str]) -> DataFrame:
    """One row per id of either side: columns in `over` prefer first's value, others second's."""
    both = first.alias("a").join(second.alias("b"), id_col, "full")
    return both.select(id_col, *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in over else F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns))
