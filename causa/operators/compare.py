"""Comparison of granted with calculated items and of fields of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causa.functions import similarity, text
from causa.operators import items
from causa.sources import files


def missing_items(granted: DataFrame, calculated: DataFrame) -> DataFrame:
    """Granted items (case_id, item_no, name, canonical, low) without a calculated one of the case that has
    the same canonical name or contains the name or is contained in it.

    Equal canonical names go by an equi-join first; only the rest is compared by containment, within the case. Names
    repeat, so they are read once per different one.
    """
    named = lambda rows: items.with_values(rows, "name", canonical=text.canonical_name(F.col("name")), low=F.lower(F.trim("name")))
    given = named(granted.select("case_id", "item_no", "name")).select("case_id", "item_no", "name", "canonical", "low")
    there = named(calculated.select("case_id", "name")).select("case_id", "canonical", F.col("low").alias("calc_low"))
    rest = given.join(there.select("case_id", "canonical").distinct(), ["case_id", "canonical"], "left_anti")
    low = there.select(F.col("case_id").alias("calc_case"), "calc_low").distinct()
    near = (F.col("case_id") == F.col("calc_case")) & (F.contains("calc_low", "low") | F.contains("low", "calc_low"))
    return rest.join(low, near, "left_anti").select("case_id", "item_no", "name", "canonical", "low")


def drop_similar(missing: DataFrame, calculated: DataFrame, threshold: int = 85) -> DataFrame:
    """Missing items none of the case's calculated names resembles; similarity is scored on distinct pairs of names.

    Both sides are written first, as they are read twice: for the pairs, and to drop what resembles. Up to few pairs are broadcast.
    """
    missing = files.kept(missing.select("case_id", "item_no", "name", "low"), "missing")
    low = files.kept(calculated.join(missing.select("case_id").distinct(), "case_id", "left_semi").select("case_id", F.lower(F.trim("name")).alias("calc_low")).distinct(), "calculated")
    pairs = missing.select("case_id", "low").distinct().join(low, "case_id").select("low", "calc_low").distinct()
    alike = files.kept(pairs.where(similarity.token_set_ratio("low", "calc_low") >= threshold), "alike")
    hit = low.join(F.broadcast(alike) if alike.count() <= items.FEW else alike.hint("merge"), "calc_low").select("case_id", "low").distinct()
    return missing.join(hit, ["case_id", "low"], "left_anti").select("case_id", "item_no", "name")


def differs(said: Column, calculated: Column) -> Column:
    """Both present, and neither contains the other once dashes are gone."""
    bare = lambda c: F.translate(F.lower(c), "-_", "")
    a, b = bare(said), bare(calculated)
    return a.isNotNull() & b.isNotNull() & ~F.contains(a, b) & ~F.contains(b, a)


def majority(candidates: Column) -> Column:
    """Most frequent entry of an array, of equally frequent ones the first; null for an empty array."""
    counted = F.transform(F.array_distinct(candidates), lambda v: F.struct(F.size(F.filter(candidates, lambda x: x == v)).alias("n"), (-F.array_position(candidates, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]
