"""Columns derived from dates, schedules and amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causa import catalogs

_CLOCK = r"das?\s+(\d{1,2})[h:](\d{0,2})\s*[àa]s?\s*(\d{1,2})[h:](\d{0,2})"
_BREAK = r"com\s+(\d{1,2})\s*h"


def hours_per_day(schedule: Column) -> Column:
    """Hours between two times, over midnight if need be, less the break; null outside 0 to 12."""
    part = lambda n: F.coalesce(F.regexp_extract(schedule, _CLOCK, n).try_cast("double"), F.lit(0.0))
    start, end = part(1) + part(2) / 60, part(3) + part(4) / 60
    worked = F.when(end >= start, end - start).otherwise(end - start + 24) - F.coalesce(F.regexp_extract(schedule, _BREAK, 1).try_cast("double"), F.lit(0.0))
    return F.when(schedule.rlike(_CLOCK) & (worked > 0) & (worked <= 12), worked)


def divisor(hours: Column) -> Column:
    """Divisor of monthly pay: named directly, else from the weekly hours, else 30 sixths of them rounded up."""
    direct = F.regexp_extract(hours, r"divisor\s+(?:de\s+)?(\d{3})", 1).try_cast("int")
    weekly = F.regexp_extract(hours, r"(\d{2})\s*(?:h|horas)\s*semanais", 1).try_cast("int")
    known = reduce(lambda w, e: w.when(weekly == e[0], e[1]), catalogs.DIVISORS.items(), F.when(F.lit(False), 0))
    return F.coalesce(direct, known, F.ceil(weekly / 6 * 30).cast("int"))


def limitation(filed: Column) -> Column:
    """Five years before filing; 29 February becomes 28 February."""
    return F.add_months(filed, -60)


def months_worked(start: Column, end: Column) -> Column:
    """Months from start to end; the last one counts from its 15th day."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + F.when(F.dayofmonth(end) >= 15, 1).otherwise(0)


def notice_days(start: Column, end: Column) -> Column:
    """30 days and three for each full year, 90 at most."""
    return F.least(F.lit(90), F.lit(30) + 3 * F.least(F.lit(20), F.floor(F.datediff(end, start) / 365))).cast("int")


def damage_band(amount: Column, salary: Column) -> Column:
    """Band of a damage award in multiples of the salary."""
    times = amount / salary
    return F.when(times <= 3, "light").when(times <= 5, "medium").when(times <= 20, "grave").when(times <= 50, "gravest").otherwise("above")


def epoch_ms(local: Column) -> Column:
    """Milliseconds of a local date (three hours behind UTC) at midnight."""
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), "-03:00"))
