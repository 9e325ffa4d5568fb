"""Fields with a value and a tier, each from its sources in order of trust."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import text
from causa.operators import fields


def _valued(value: Column, tier: Column | str) -> Column:
    """struct(value, tier), null without a value."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), (F.lit(tier) if isinstance(tier, str) else tier).alias("tier")))


def case_number(c: Column) -> Column:
    """The first labelled number, else the first of all; high if its check digits are 98 less the rest by 97, else medium."""
    found = F.coalesce(fields.field(c, f"(?iu){catalogs.NUMBER_LABEL}({catalogs.CASE_NUMBER})"), fields.field(c, catalogs.CASE_NUMBER))
    return _valued(found, F.when(text.check_digit_ok(found, factor=1), "high").otherwise("medium"))


def ruling_date(c: Column) -> Column:
    """The latest signature, else the first publication that is a date, else the first date in words after a city."""
    published = F.try_to_date(fields.field(c, f"(?iu){catalogs.PUBLISHED_ON}"), "dd/MM/yyyy")
    words = F.transform(F.regexp_extract_all(c, F.lit(catalogs.SPELLED_AFTER_CITY), F.lit(1)), lambda d: text.parse_date(F.lower(F.regexp_replace(d, r"\s+", " "))))
    return _valued(F.coalesce(fields.latest_date(c, catalogs.SIGNED_ANY), published, F.get(F.filter(words, lambda d: d.isNotNull()), 0)), "high")


def by_priority(c: Column, catalog: Sequence[tuple[str, str, str]]) -> Column:
    """Label and tier of the first wording of a catalog that a text holds, wherever it stands."""
    return F.coalesce(*(F.when(c.rlike(f"(?iu){p}"), F.struct(F.lit(label).alias("value"), F.lit(tier).alias("tier"))) for p, label, tier in catalog))


def notice_days(c: Column, low: int = 20, high: int = 90) -> Column:
    """Days of notice as "N dias", from the first direct wording, else the first inverted; null outside the bounds.

    A direct wording outside the bounds is not replaced by an inverted one.
    """
    days = F.coalesce(*(fields.field(c, f"(?iu){p}") for p in catalogs.NOTICE_DAYS)).try_cast("int")
    return _valued(F.when(days.between(low, high), F.concat(days.cast("string"), F.lit(" dias"))), "medium")
