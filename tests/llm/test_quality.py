"""The quality cascade against plain counts, and the order that it takes from costs and shares."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causa.llm import quality


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def texts():
    rng = random.Random(5)
    some = [" ".join(rng.choice(["a", "b", "ç", "dd", "#x"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    lines = ["\n".join(rng.choice(["one two", "one two ", "", " \t", "three", "- item"]) for _ in range(12)) for _ in range(20)]
    long = " ".join(f"w{i}" for i in range(60_000)) + " tail w1 w2 w3"
    return [None, "", " \n\t\x0b", "one", "one two", "a b c a b c", "a a a a", "x\x1cy z", " lead and trail ", "a<b & c|d \U0001f600 $", "𝒳 é ü", long, *some, *lines]


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, t, 9, "f", True) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string, row boolean")


def test_counts_equal_plain_ones(spark, counted):
    got = {r["doc_id"]: tuple(r[1:]) for r in counted.select("doc_id", quality.counts(F.col("text")).alias("q")).select("doc_id", "q.*").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts())}


def test_windows_that_agree_in_high_bits_only_are_told_apart(spark, monkeypatch):
    # with 58 bits for places, six bits of each hash are left: most neighbours are equal in those only
    monkeypatch.setattr(quality, "_BITS", 58)
    monkeypatch.setattr(quality, "_LOW", (1 << 58) - 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()) if len(t or "") < 5000], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", quality.counts(F.col("text"))["n_repeat_words"]).collect()}
    assert got == {i: plain(texts()[i])[4] for i in got}


def test_texts_with_more_windows_than_places(spark, monkeypatch):
    monkeypatch.setattr(quality, "_BITS", 3)
    monkeypatch.setattr(quality, "_LOW", 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()) if len(t or "") < 5000], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", quality.counts(F.col("text"))["n_repeat_words"]).collect()}
    assert got == {i: plain(texts()[i])[4] for i in got}


def test_rules_go_by_rejections_per_second():
    rule = {n: quality.Rule(n, "true") for n in "abcd"}
    measured = [quality.Measured(rule["a"], 1.0, 0.5), quality.Measured(rule["b"], 0.1, 0.1), quality.Measured(rule["c"], 0.01, 0.0), quality.Measured(rule["d"], 0.001, 0.0)]
    assert [r.name for r in quality.ordered(measured)] == ["b", "a", "d", "c"]


def test_sample_gives_share_and_cost(spark):
    df = spark.createDataFrame([(f"word{i} " * (i + 1),) for i in range(200)], "text string")
    dear = "size(array_sort(split(repeat(text, 200), ' '), (x, y) -> if(x < y, -1, if(x > y, 1, 0)))) < 0"
    few, slow = quality.measure(df, [quality.Rule("few", "n_words < 50"), quality.Rule("slow", dear)], sample_rows=10_000)
    assert few.share == 49 / 200 and slow.share == 0 and slow.cost > few.cost
    assert quality.measure(df, [quality.Rule("all", "true")], sample_rows=100)[0].share == 1


def test_later_rules_are_not_evaluated(spark):
    df = spark.createDataFrame([(1,)], "n int").select(quality.verdict([quality.Rule("first", "n = 1"), quality.Rule("never", "raise_error('evaluated') is null")]).alias("failed"))
    assert df.first()["failed"] == "first"


def test_cascade_keeps_rows_and_clashing_columns(spark, counted):
    docs = counted.unionByName(counted.limit(3))
    found = quality.cascade(docs)
    assert found.columns == [*docs.columns, "quality"] and found.count() == docs.count()
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, good + " #" * 40), (3, "- point\n" * 60), (4, "\n".join(f"line{i} breaks{i} number{i} ..." for i in range(40))), (5, None), (6, "123 456 " * 10 + " ".join(str(i) for i in range(90))), (7, good)]
    got = {r.doc_id: r.quality for r in quality.cascade(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: q.kept for i, q in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert got[2].failed == "symbols" and got[4].failed == "broken_lines" and got[5].failed == "few_words" and got[1].failed is None


def test_empty_table(spark, counted):
    assert quality.cascade(counted.limit(0)).collect() == []
