"""Quality rules in a short-circuit cascade, with DataFrame and SQL functions only.

A rule is a condition under which a text is rejected. On a sample of about
`sample_rows` documents each rule's cost (seconds a row) and selectivity (share of
rows that it rejects) are measured, and the rules are ordered by rejections per
second, the best first. In that order they become the branches of one CASE
expression, so a row is charged for the rules up to the first that rejects it.
The order decides what a run costs and which rule is named for a row that
several would reject; which rows are kept doesn't depend on it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causa.llm.common import saved, unused

SAMPLE_ROWS = 2000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A SQL condition on the columns of the documents; rows for which it is null are not rejected by it."""

    name: str
    rejects: str


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float  # seconds a row
    share: float  # of the sample's rows, rejected


#: Counts that rules may refer to beside the text (see counts()).
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: The first two are the base; the rest look at word lengths, symbols, repeated lines, words without a letter,
#: and lines that start as list items or break off.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("no_letters", rf"5 * size(filter(split(text, r'{SPACE}'), w -> w <> '' and not w rlike r'\p{{L}}')) > 2 * n_words"),
    Rule("list_items", r"10 * regexp_count(text, r'(?:^|\n)[\x20\t]*[-*\x{2022}][\x20\t]') > 9 * n_lines"),
    Rule("broken_lines", r"10 * regexp_count(text, r'(?:\.\.\.|\x{2026})[\x20\t\r]*(?:\n|\z)') > 5 * n_lines"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BITS = 20
_LOW = (1 << _BITS) - 1


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text; windows are told apart by 64-bit hashes."""

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(w, F.lit(3), n), lambda a, b: F.xxhash64(a, b))

    def neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        like = lambda x, j: F.coalesce(same(x, F.get(s, j)), F.lit(False))
        return F.filter(s, lambda x, j: like(x, j + 1) | like(x, j - 1))

    def covered(places: Column) -> Column:
        # each repeated window covers its words up to the next one's first
        step = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return _let(F.sort_array(places), lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda a, b: a + b))

    def by_pairs(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return covered(F.transform(_let(order, lambda s: neighbours(s, lambda x, y: x["h"] == y["h"])), lambda x: x["i"]))

    def by_words(hashes: Column) -> Column:
        # a hash's high bits and its place in one number sort as plain longs; where high bits alone agree, pairs are sorted
        alike = lambda x, y: F.shiftright(x.bitwiseXOR(y), _BITS) == 0
        order = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i)))
        place = lambda x: x.bitwiseAND(F.lit(_LOW))
        whole = lambda x: F.get(hashes, place(x).cast("int"))
        mixed = lambda s: F.exists(F.transform(s, lambda x, j: F.coalesce(alike(x, F.get(s, j + 1)) & (whole(x) != whole(F.get(s, j + 1))), F.lit(False))), lambda x: x)
        return _let(_let(order, lambda s: neighbours(s, alike)), lambda s: F.when(mixed(s), by_pairs(hashes)).otherwise(covered(F.transform(s, place))))

    # most texts repeat no window: that is seen without sorting
    once = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    found = lambda h: F.when(once(h), F.lit(0)).when(F.size(h) > _LOW, by_pairs(h)).otherwise(by_words(h))
    return _let(windows(words), found)


def counts(text: Column) -> Column:
    """A struct of COUNTS (long) of one text; a null text has no words and no lines.

    Words are runs of anything but space and the controls 9 to 13; lines are
    parted by line feeds and count where they hold a word.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), _repeated(w).alias("repeat"))
    of_lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("once"))
    found = lambda s: F.struct(*(c.cast("long").alias(n) for n, c in zip(COUNTS, (
        s["w"]["n"], s["w"]["chars"], s["symbols"], s["l"]["n"] - s["l"]["once"], s["w"]["repeat"], s["l"]["n"],
    ), strict=True)))
    return _let(F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("symbols")), found)


def _counted(texts: DataFrame) -> DataFrame:
    return texts.withColumn("counts", counts(F.col("text"))).select(*texts.columns, "counts.*")


def measure(texts: DataFrame, rules: Iterable[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 3, runs: int = 2) -> list[Measured]:
    """Cost and selectivity of each rule on the same sample: about sample_rows rows of the one-column frame of texts.

    The sample is written once, with its counts, so that a rule is charged for its
    own work only; the time of a pass without any rule is taken off. Of `runs`
    passes the shortest counts. An empty table measures nothing: cost and share are zero.
    """
    rules = list(rules)
    rows = texts.count()
    drawn = texts.sample(min(1.0, sample_rows / rows), seed) if rows else texts
    # a bounded number of rows: one task reads them, so that times can be compared
    sample = saved(_counted(drawn.repartition(1)))
    n = sample.count()
    if not n:
        return [Measured(r, 0.0, 0.0) for r in rules]

    def timed(condition: str) -> tuple[float, int]:
        took, found = [], 0
        for _ in range(runs):
            began = time.perf_counter()
            found = sample.agg(F.count_if(F.expr(condition))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), found

    timed("true")  # the first pass also compiles
    alone, _ = timed("true")
    out = []
    for r in rules:
        took, found = timed(f"coalesce({r.rejects}, false)")
        out.append(Measured(r, max(took - alone, 1e-4) / n, found / n))
    return out


def ordered(measured: Iterable[Measured]) -> list[Rule]:
    """Rejections per second, the most first; rules that reject nothing go by cost, then by name."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.share / max(m.cost, 1e-12), m.cost, m.rule.name))]


def verdict(rules: Iterable[Rule]) -> Column:
    """The first rule in the given order that rejects the row, or null; later ones aren't evaluated."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.rejects), F.lit(r.name)) if out is None else out.when(F.expr(r.rejects), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def cascade(docs: DataFrame, rules: Iterable[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows of docs with quality: struct(COUNTS..., failed, kept).

    failed names the first rule of the measured order that rejects the row; kept
    is true where none does. A null or empty text has no words and fails
    few_words. Rows are kept as they are, repeats included; extra columns stay
    and can't clash with what rules name, as rules see the text and the counts only.
    """
    rules, own, name = tuple(rules), unused(docs, "row"), unused(docs, "quality")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    order = ordered(measure(docs.select(text), rules, sample_rows))
    frame = _counted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(own), text)).withColumn("failed", verdict(order))
    found = F.struct(*COUNTS, "failed", F.col("failed").isNull().alias("kept"))
    return frame.select(*(F.col(f"{own}.`{c}`").alias(c) for c in docs.columns), found.alias(name))
