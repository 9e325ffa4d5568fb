"""Normalisation, parsing and formatting of text values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causa import catalogs


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is computed once and then read by its name, however often f has it."""
    return F.transform(F.array(c), f)[0]


def norm_text(c: Column) -> Column:
    """Lower case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), *catalogs.ACCENTS), r"\s+", " "))


def clean_null(c: Column, markers: Sequence[str] = catalogs.NULL_MARKERS) -> Column:
    """The trimmed value, or null for a marker of a missing one."""
    return F.when(~F.lower(F.trim(c)).isin(*markers), F.trim(c))


def clean_bool(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*catalogs.TRUE_WORDS), True).when(word.isin(*catalogs.FALSE_WORDS), False)


def first_match(c: Column, catalog: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """Value of the first pattern of an ordered catalog that occurs in a text, without regard to case."""
    chain = reduce(lambda w, e: w.when(c.rlike(f"(?iu){e[0]}"), e[1]), catalog[1:], F.when(c.rlike(f"(?iu){catalog[0][0]}"), catalog[0][1]))
    return chain.otherwise(default) if default is not None else chain


def canonical_name(c: Column) -> Column:
    return first_match(c, catalogs.CANONICAL_ITEMS, F.trim(c))


def canonical_key(c: Column) -> Column:
    return first_match(c, catalogs.CANONICAL_KEYS, F.lower(F.trim(c)))


def phrase_key(c: Column, catalog: Sequence[tuple[str, str]] = catalogs.PHRASES) -> Column:
    """Key of a phrase: equal first, else the first entry that contains it or is contained.

    Both sides are normalised; entries of three letters or fewer match whole words only.
    """
    plain = [(_plain(p), k) for p, k in catalog]

    def key(text: Column) -> Column:
        near = []
        for p, k in plain:
            inside = F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {p} ") if len(p) <= 3 else text.contains(p)
            near.append(F.when(inside | ((F.length(text) > 3) & F.lit(p).contains(text)), k))
        return F.coalesce(*(F.when(text == p, k) for p, k in plain), *near)

    return _once(norm_text(c), key)


def _plain(p: str) -> str:
    return " ".join(p.lower().translate(str.maketrans(*catalogs.ACCENTS)).split())


#: What counts as an amount: the first number; one marked as money, with cents; a signed one with cents that is the whole text; all digits, points and commas of a text.
MONEY = {"first": r"(-?\d[\d.]*(?:,\d{1,2})?)", "marked": r"R\$\s*(\d[\d.]*,\d{2})", "signed": r"^\s*(?:R\$\s*)?(-?\d[\d.]*,\d{2})\s*$", "digits": None}


def parse_money(c: Column, variant: str = "first") -> Column:
    """Brazilian amount of a text (1.234,56) as decimal(18,2), by a variant of MONEY."""
    pattern = MONEY[variant]
    found = F.regexp_replace(c, r"[^\d,.]", "") if pattern is None else F.regexp_extract(c, pattern, 1)
    return F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def format_money(c: Column) -> Column:
    """R$ 1.234,56"""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def parse_date(c: Column) -> Column:
    """DD/MM/YYYY, DD-MM-YYYY, ISO, `d de month de yyyy`, or DD/MM/YY, where years from 69 on are of the 20th century."""
    text = F.trim(c)
    words = F.regexp_extract(F.lower(text), r"^(\d{1,2}) de ([a-zç]+) de (\d{4})$", 2)
    month = reduce(lambda w, e: w.when(words == e[1], e[0]), enumerate(catalogs.MONTHS, 1), F.when(words == "marco", 3))
    spelled = F.concat_ws("-", F.regexp_extract(text, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, r"^(\d{1,2}) de", 1), 2, "0"))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(text, "d/M/yy"))
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(short, F.try_to_date(text, "d/M/yyyy"), F.try_to_date(text, "d-M-yyyy"), F.try_to_date(text, "yyyy-M-d"), F.when(month.isNotNull(), F.try_to_date(spelled, "yyyy-MM-dd")))


def dmy(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


NUMBER = r"(\d{7})-(\d{2})\.(\d{4})\.(\d)\.(\d{2})\.(\d{4})"


def check_digit_ok(c: Column, factor: int = 100) -> Column:
    """Whether a case number's two digits are 98 minus the rest of it, times the factor, by 97; null without a number.

    100 leaves the digits' own place free, as the public rule has it; 1 takes the rest as it stands.
    """
    part = lambda found, at, n: F.substring(found, at, n)  # noqa: E731  the number is of fixed width, so its parts have fixed places

    def ok(found: Column) -> Column:
        rest = F.concat(part(found, 1, 7), part(found, 12, 4), part(found, 17, 1), part(found, 19, 2), part(found, 22, 4)).try_cast("long") % 97 * factor % 97
        return F.when(found != "", F.lit(98) - rest == part(found, 9, 2).try_cast("int"))

    return _once(F.regexp_extract(c, NUMBER, 0), ok)


def plain_format(c: Column) -> Column:
    """Value to copy: identity numbers of 11 or 14 digits bare, ISO dates as DD/MM/YYYY, single spaces."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    iso = F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})$", 1) != ""
    return (
        F.when(c.rlike(r"^[0-9./-]+$") & F.length(digits).isin(11, 14), digits)
        .when(iso, F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})$", r"$3/$2/$1"))
        .otherwise(F.trim(F.regexp_replace(c, r"\s+", " ")))
    )


def alert_level(c: Column) -> Column:
    found = F.regexp_extract(c, r"^\[(\w+)\]", 1)
    return F.when(found == "", "AVISO").otherwise(F.upper(found))


def alert_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\[\w+\]\s*", ""))


def status_bucket(c: Column) -> Column:
    """Denial is tested first, as its words contain those of a grant."""
    s = F.lower(F.trim(c))
    return F.when(s.contains("indefer") | s.contains("improced"), "denied").when(s.contains("parcial"), "partial").when(s.contains("defer") | s.contains("proced"), "granted").otherwise("unknown")


def cut_repeat(c: Column, notice: str, ruling: str, label: str, near: int = 300) -> Column:
    """Text before its repeated tail, without white space at its end; null stays null.

    The tail begins at the first notice. Where there is none it begins at the
    second ruling marker, or at the last page label if one begins at most near
    characters before that marker. A text with neither stays as it is.
    """
    head = lambda end: F.regexp_replace(F.substring(c, F.lit(1), end - 1), r"\s+$", "")

    def snapped(at: Column) -> Column:
        start = F.greatest(at - near, F.lit(1))
        back = F.locate(label[::-1], F.reverse(F.substring(c, start, at - start)))
        return _once(back, lambda b: F.when(b > 0, at - b + 1 - len(label)).otherwise(at))

    def from_first(one: Column) -> Column:
        after = one + F.length(F.regexp_extract(c, ruling, 0))
        return F.when(one > 0, _once(after, from_second)).otherwise(c)

    def from_second(after: Column) -> Column:
        two = F.regexp_instr(F.substring(c, after, F.length(c)), F.lit(ruling))
        return _once(two, lambda n: F.when(n > 0, head(snapped(after + n - 1))).otherwise(c))

    return _once(F.regexp_instr(c, F.lit(notice)), lambda n: F.when(n > 0, head(n)).otherwise(_once(F.regexp_instr(c, F.lit(ruling)), from_first)))
