"""Parameters with validity: shapes of files, overlaps, gaps, and both joins."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from causa.sources import parameters

D = datetime.date


def records():
    wage = lambda y, since, until, v: {"id": f"wage_{y}", "valor": v, "vigencia": {"inicio": since, "fim": until}}
    bands = [{"faixa": 1, "base_calculo_ate": 1000.0, "aliquota": 0.0, "deducao": 0.0}, {"faixa": 2, "base_calculo_de": 1000.01, "aliquota": 0.1, "deducao": 100.0}]
    return [
        wage(2019, "2019-01-01", "2019-12-31", 998.0),
        wage(2021, "2021-01-01", None, 1100.0),
        {"id": "tax_2020", "faixas": bands, "vigencia": {"inicio": "2020-02-01", "fim": None}},
        {"id": "rate", "regra": {"after": "X"}, "vigente": True},
    ]


def test_shapes_of_files(spark, tmp_path):
    for i, r in enumerate(records()):
        (tmp_path / f"{i}.json").write_text(json.dumps(r, indent=2))
    (tmp_path / "bad.json").write_text("{ no json")
    (tmp_path / "none.json").write_text('{"valor": 3}')
    got = {(r.param, r.since, r.until, r.band, r.amount and float(r.amount), r.rate and float(r.rate)) for r in parameters.read(spark, str(tmp_path)).collect()}
    assert got == {
        ("wage", D(2019, 1, 1), D(2019, 12, 31), None, 998.0, None), ("wage", D(2021, 1, 1), None, None, 1100.0, None),
        ("tax", D(2020, 2, 1), None, 1, None, 0), ("tax", D(2020, 2, 1), None, 2, None, 0.1), ("rate", None, None, None, None, None),
    }
    assert parameters.read(spark, str(tmp_path)).where("param = 'rate'").head().terms == '{"after":"X"}'


def table(spark, extra=()):
    return parameters.rows(spark.createDataFrame([(json.dumps(r),) for r in (*records(), *extra)], "record string"))


def test_overlapping_parameters_are_refused(spark):
    assert parameters.checked(table(spark)).count() == 5
    clash = {"id": "wage_2018", "valor": 1, "vigencia": {"inicio": None, "fim": "2019-01-01"}}
    assert [(r.param, r.since) for r in parameters.overlaps(table(spark, [clash])).collect()] == [("wage", D(2019, 1, 1))]
    with pytest.raises(ValueError, match="wage from 2019-01-01"):
        parameters.checked(table(spark, [clash]))
    next_day = {"id": "wage_2020", "valor": 1, "vigencia": {"inicio": "2020-01-01", "fim": "2020-12-31"}}
    assert parameters.checked(table(spark, [next_day])).count() == 6


@pytest.mark.parametrize("small", [parameters.SMALL, 0])
def test_value_in_force_by_either_join(spark, small):
    days = [D(2018, 12, 31), D(2019, 1, 1), D(2019, 12, 31), D(2020, 5, 5), D(2021, 1, 1), D(2150, 1, 1), None]
    facts = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, day date")
    got = parameters.in_force(facts, table(spark), "day", "wage", small=small).select("i", F.col("p_amount").cast("double").alias("v"))
    assert {r.i: r.v for r in got.collect()} == {0: None, 1: 998.0, 2: 998.0, 3: None, 4: 1100.0, 5: 1100.0, 6: None}
    amounts = [(0, D(2020, 1, 31), 5.0), (1, D(2020, 2, 1), 1000.0), (2, D(2020, 2, 1), 1000.01), (3, D(2300, 1, 1), 9999.0), (4, D(2021, 1, 1), None)]
    facts = spark.createDataFrame(amounts, "i int, day date, base double").withColumn("base", F.col("base").cast("decimal(18,2)"))
    found = parameters.in_force(facts, table(spark), "day", "tax", base="base", small=small)
    assert {r.i: r.p_band for r in found.collect()} == {0: None, 1: 1, 2: 2, 3: 2, 4: None}
    always = parameters.in_force(facts, table(spark), "day", "rate", small=small)
    assert {r.p_terms for r in always.collect()} == {'{"after":"X"}'} and always.count() == 5


def test_empty_table(spark):
    empty = parameters.rows(spark.createDataFrame([], "record string"))
    facts = spark.createDataFrame([(1, D(2020, 1, 1))], "i int, day date")
    assert parameters.checked(empty).count() == 0
    assert parameters.in_force(facts, empty, "day", "wage").head().p_amount is None
