"""Catalog table against the chain of conditions and against a plain loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import text
from causa.operators import phrases


def plain_loop(texts, catalog):
    """First entry equal, else first that holds or is held, by the words of the contract."""
    out = {}
    for t in {t for t in texts if t}:
        same = [r for r, p, _ in catalog if p == t]
        near = [r for r, p, _ in catalog if p and ((f" {p} " in f" {t} " if len(p) < 4 else p in t) or (len(t) >= 4 and t in p))]
        if same or near:
            out[t] = min(same or near)
    return out


def found(spark, texts, catalog):
    rows = spark.createDataFrame([(t, "clash") for t in texts], "v string, plain string")
    table = spark.createDataFrame(catalog, "rank long, phrase string, key string")
    return phrases.keys(rows, table, "v")


def test_equals_the_chain_of_conditions(spark):
    catalog = [(i, p, k) for i, (p, k) in enumerate(catalogs.PHRASES)]
    texts = ["Taxa SELIC", "contrato", "TR", "pagamento de FGTS", "zzz", "Férias", "o dsr e o rsr", "dsrx", "adicional", None, "", "13º  SALÁRIO proporcional", *(p for p, _ in catalogs.PHRASES[::5])]
    got = {r.plain: r.key for r in found(spark, texts, catalog).collect()}
    chain = spark.createDataFrame([(t,) for t in texts], "v string").select(text.norm_text(F.col("v")).alias("plain"), text.phrase_key(F.col("v")).alias("key")).where("plain <> '' and key is not null")
    assert got == {r.plain: r.key for r in chain.collect()} and "dsrx" not in got


def test_many_phrases_against_a_loop(spark):
    rng = random.Random(3)
    letters = ["ab", "ba", "aab", "b", "c ", " ", "ca", "d"]
    word = lambda n: " ".join("".join(rng.choice(letters) for _ in range(n)).split())
    catalog = [(i, word(rng.randint(1, 7)), str(i)) for i in range(400)]
    texts = [word(rng.randint(1, 9)) for _ in range(300)]
    assert {r.plain: r.rank for r in found(spark, texts, catalog).collect()} == plain_loop(texts, catalog)


def test_ten_thousand_phrases(spark):
    rng = random.Random(4)
    catalog = [(i, f"{rng.randint(0, 10**9):x} artigo {i}", str(i)) for i in range(10_000)]
    texts = [f"nos termos de {catalog[i][1]} e mais" for i in range(0, 10_000, 100)] + ["artigo", "nada"]
    got = {r.plain: r.rank for r in found(spark, texts, catalog).collect()}
    due = plain_loop(texts, catalog)
    assert got == due and len(due) == 101


def test_empty_tables_and_repeated_phrases(spark):
    assert found(spark, [], [(1, "abc", "k")]).count() == 0
    assert found(spark, ["abcd"], []).count() == 0
    rows = found(spark, ["x", "abcd abcd"], [(2, "ABCD", "late"), (1, "abcd", "first"), (3, None, "null"), (4, "", "none"), (5, "x", "one"), (6, "a b", "two")]).collect()
    assert {(r.plain, r.key) for r in rows} == {("x", "one"), ("abcd abcd", "first")}
    assert [r.key for r in found(spark, ["z a b z"], [(6, "a b", "two")]).collect()] == ["two"]


def test_long_texts_meet_long_phrases_without_grams(spark, monkeypatch):
    cut, plain = [], phrases.candidates

    def watched(texts, catalog):
        cut.extend(r.plain for r in texts.select("plain").collect())
        return plain(texts, catalog)

    monkeypatch.setattr(phrases, "candidates", watched)
    long = f"{'outra palavra ' * 20}xalfa beta gamay {'outra palavra ' * 20}".strip()
    got = found(spark, [long, "beta gam", "alfa gama"], [(1, "alfa beta gama", "k")]).collect()
    assert {r.plain for r in got} == {long, "beta gam"} and sorted(cut) == ["alfa gama", "beta gam"]
