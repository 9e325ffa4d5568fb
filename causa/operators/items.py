"""Operators on granted items (case_id, item_no, name, status, period, reflexes, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causa.functions import text
from causa.sources import files

#: Different texts that are broadcast.
FEW = 20_000
#: Code points of all of them together, where texts may be long.
SMALL = 16_000_000


def clean(items: DataFrame) -> DataFrame:
    """Trimmed names, a default status, null for blanks and reflexes as an array."""
    parts = F.filter(F.split(F.replace("reflexes", F.lit(" e "), F.lit(", ")), ", "), lambda x: x != "")
    return items.withColumns({"name": F.trim("name"), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("deferida")), "period": F.nullif("period", F.lit("")), "reflexes": parts})


def ranked(items: DataFrame) -> DataFrame:
    """Adds canonical and rn: the place among the case's items of one canonical key and period."""
    rows = items.select("case_id", "item_no", "name", F.lower(F.trim("period")).alias("period"), text.canonical_key(F.col("name")).alias("canonical"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("case_id", "canonical", "period").orderBy("item_no")))


def longest_phrase(clause: Column, phrases: Sequence[str]) -> Column:
    """The longest phrase of a list that a clause holds, without regard to case."""
    ordered = sorted(phrases, key=lambda p: -len(p))
    return F.transform(F.array(F.lower(clause)), lambda c: F.coalesce(*(F.when(c.contains(p), p) for p in ordered)))[0]


def reflexes(clause: Column) -> Column:
    """Lower-case names after "reflexos em", up to a full stop."""
    named = F.regexp_extract(F.lower(clause), r"reflexos em ([^.]+)", 1)
    return F.filter(F.split(named, r",\s+|\s+e\s+"), lambda x: x != "")


def percent_near(lower_text: Column, term: str) -> Column:
    """The first percentage from 30 characters before a term to 60 after it."""
    at = F.instr(lower_text, term)
    window = F.substring(lower_text, F.greatest(F.lit(1), at - 30), at + 60 - F.greatest(F.lit(1), at - 30))
    return F.when(at > 0, F.regexp_extract(window, r"(\d+)\s*%", 1).try_cast("double"))


def with_family(items: DataFrame) -> DataFrame:
    """Adds canonical, family and whether the item is derived from others."""
    c = F.col("canonical")
    family = F.when(c.isin("Horas Extras", "Adicional Noturno", "DSR"), "jornada").when(c.isin("Férias", "13º Salário", "Aviso Prévio", "Saldo de Salário"), "rescisão").when(c.startswith("Dano"), "dano").when(c.startswith("Multa"), "multa")
    return items.withColumn("canonical", text.canonical_name(F.col("name"))).withColumn("family", family).withColumn("derived", c.isin("DSR", "FGTS"))


def with_values(rows: DataFrame, column: str, few: int = FEW, **values: Column) -> DataFrame:
    """Rows with columns that follow from one text column, computed once per different text.

    The texts are written and counted: up to few of them are broadcast, more are joined on plain exchanges, which AQE can split.
    """
    texts = files.kept(rows.select(column).where(F.col(column).isNotNull()).distinct().withColumns(values), "texts")
    return rows.join(F.broadcast(texts) if texts.count() <= few else texts.hint("merge"), column, "left")


def with_shared_values(rows: DataFrame, column: str, few: int = FEW, small: int = SMALL, **values: Column) -> DataFrame:
    """with_values() of a column that may be long and different in every row: such texts are read where they stand, never exchanged.

    A sketch tells beforehand how many texts differ; where at most few do, of small code points together, each is read once and broadcast.
    """
    size = rows.select(F.approx_count_distinct(column).alias("n"), F.max(F.length(column)).alias("longest")).first()
    if size["n"] > few or size["n"] * (size["longest"] or 0) > small:
        return rows.withColumns(values)
    return with_values(rows, column, few, **values)
