"""Fields with tiers: order of sources, bounds, nulls."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import text
from causa.operators import tiered

GOOD, BAD = "0001234-58.2023.5.04.0001", "0001234-56.2023.5.04.0001"


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("f")).orderBy("i").collect()
    return [r.f and (r.f.value, r.f.tier) for r in rows]


def test_check_digits_are_98_less_the_rest_by_97(spark):
    rows = spark.createDataFrame([(GOOD,), (BAD,), ("0001234-75.2023.5.04.0001",)], "n string")
    assert [r.ok for r in rows.select(text.check_digit_ok(F.col("n"), factor=1).alias("ok")).collect()] == [True, False, False]


def test_case_number(spark):
    got = values(spark, [f"{BAD} e Processo: {GOOD}", f"autos {BAD}", f"x {GOOD} {BAD}", "nada", "", None], tiered.case_number)
    assert got == [(GOOD, "high"), (BAD, "medium"), (GOOD, "high"), None, None, None]


def test_ruling_date(spark):
    signed = "Assinado eletronicamente por A em 10/03/2024. Assinado eletronicamente por B em 09/03/2024."
    got = values(spark, [f"Publicado em 01/01/2025. {signed}", "publicada em 05/06/2020; Canoas, 1 de maio de 2019", "Canoas, 31 de fevereiro de 2020. Esteio, 2 de Março de 2021", "em 2 de março de 2021", None], tiered.ruling_date)
    due = [datetime.date(2024, 3, 10), datetime.date(2020, 6, 5), datetime.date(2021, 3, 2)]
    assert got == [*((d, "high") for d in due), None, None]


def test_priority_not_place_decides(spark):
    got = values(spark, ["pedido de demissão, depois rescisão indireta", "foi com justa causa, não sem justa causa", "TÉRMINO DO CONTRATO", "por justa causa", None], lambda c: tiered.by_priority(c, catalogs.DISMISSAL_REASONS))
    assert [g and g[0] for g in got] == ["Rescisão indireta", "Com justa causa", "Término de contrato", None, None]
    got = values(spark, ["CLT; contrato de experiência", "pejotização com\nfraude", "CNPJ da ré", "vínculo de emprego"], lambda c: tiered.by_priority(c, catalogs.CONTRACT_KINDS))
    assert got == [("Experiência", "high"), ("Pejotização reconhecida", "medium"), None, ("CLT", "medium")]


def test_notice_days(spark):
    texts = ["aviso prévio indenizado de 30 dias", "45 (quarenta e cinco) dias de aviso prévio", "aviso prévio de 120 dias; 30 dias de aviso prévio", "aviso prévio de 90 dias", "aviso prévio de 19 dias", "aviso prévio de 99999999999 dias", None]
    assert [v and v[0] for v in values(spark, texts, tiered.notice_days)] == ["30 dias", "45 dias", None, "90 dias", None, None, None]
