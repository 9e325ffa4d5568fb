"""Legal parameters with validity: files of different shapes, one table, and the value in force on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of parameters of at most so many rows is broadcast; a larger one is joined by bins.
SMALL = 20_000
#: Years outside these bounds share the bin at the bound.
FIRST_BIN, LAST_BIN = 1900, 2100

_MONEY = "decimal(18,2)"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all JSON files of a folder, one record per file; see `rows`."""
    return rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("record")))


def rows(records: DataFrame) -> DataFrame:
    """(param, since, until, band, low, high, rate, deduction, amount, terms) from a column `record` of JSON text.

    A record holds one amount (`valor`), a list of bands (`faixas`, a row each) or only terms (`regra`, as JSON).
    param is the record's id without a year at its end. since and until are both inclusive, null where open.
    The first band has no low, the last no high. Records that are no JSON object, or have no id, give no row.
    """
    parsed = records.select(F.try_parse_json("record").alias("v"))
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    head = parsed.select(
        F.regexp_replace(at("v", "$.id", "string"), r"_\d{4}$", "").alias("param"),
        at("v", "$.vigencia.inicio", "string").try_cast("date").alias("since"),
        at("v", "$.vigencia.fim", "string").try_cast("date").alias("until"),
        at("v", "$.valor", _MONEY).alias("amount"),
        at("v", "$.regra", "string").alias("terms"),
        at("v", "$.faixas", "array<variant>").alias("bands"),
    ).where("param is not null")
    bands = head.select("*", F.explode_outer("bands").alias("b"))
    return bands.select(
        "param", "since", "until", at("b", "$.faixa", "int").alias("band"), at("b", "$.base_calculo_de", _MONEY).alias("low"), at("b", "$.base_calculo_ate", _MONEY).alias("high"),
        at("b", "$.aliquota", "decimal(9,6)").alias("rate"), at("b", "$.deducao", _MONEY).alias("deduction"), "amount", "terms",
    )


def overlaps(params: DataFrame) -> DataFrame:
    """(param, band, since, until) of rows that begin while an earlier row of the same parameter and band is in force.

    Of rows that begin on one day all but one count. Parameters are few rows per name, so a window over the name holds.
    """
    start, end = F.coalesce("since", F.lit("0001-01-01").cast("date")), F.coalesce("until", F.lit("9999-12-31").cast("date"))
    order = Window.partitionBy("param", "band").orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return params.select("param", "band", "since", "until", (before >= start).alias("hit")).where("hit").drop("hit")


def checked(params: DataFrame) -> DataFrame:
    """The same rows; ValueError where two of one parameter and band are in force on the same day."""
    found = overlaps(params).orderBy("param", "band", "since").limit(5).collect()
    if found:
        raise ValueError("parameters overlap: " + ", ".join(f"{r.param} from {r.since}" for r in found))
    return params


def _bin(day: Column) -> Column:
    return F.least(F.greatest(F.year(day), F.lit(FIRST_BIN)), F.lit(LAST_BIN))


def in_force(facts: DataFrame, params: DataFrame, day: str, param: str, base: str | None = None, small: int = SMALL) -> DataFrame:
    """All facts with the columns of the parameter's row in force on `day`, null where there is none or the day is null.

    base: a column of amounts, which chooses the band. Columns of both sides must differ, but for those of the row,
    which are prefixed `p_`. Up to `small` rows of the parameter are broadcast, after they are counted. More are put in
    a bin per year that they cover, so that facts meet them by an equal key and AQE can split a year that holds many.
    """
    own = params.where(F.col("param") == param)
    own = own.select(*(F.col(c).alias(f"p_{c}") for c in own.columns if c != "param"))
    holds = (F.col("p_since").isNull() | (F.col(day) >= F.col("p_since"))) & (F.col("p_until").isNull() | (F.col(day) <= F.col("p_until")))
    if base is not None:
        holds &= (F.col("p_low").isNull() | (F.col(base) >= F.col("p_low"))) & (F.col("p_high").isNull() | (F.col(base) <= F.col("p_high")))
    holds &= F.col(day).isNotNull()
    if own.limit(small + 1).count() <= small:
        return facts.join(F.broadcast(own), holds, "left")
    years = F.sequence(_bin(F.coalesce("p_since", F.make_date(F.lit(FIRST_BIN), F.lit(1), F.lit(1)))), _bin(F.coalesce("p_until", F.make_date(F.lit(LAST_BIN), F.lit(1), F.lit(1)))))
    binned = own.where("p_since is null or p_until is null or p_since <= p_until").select("*", F.explode(years).alias("p_bin"))
    return facts.join(binned, (_bin(F.col(day)) == F.col("p_bin")) & holds, "left").drop("p_bin")
