"""Operators on inline rows."""

from __future__ import annotations

import datetime as dt
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import calculation, derive, similarity, text
from causa.operators import compare, fields, items, learning, pages, rules
from causa.plans import cases, legal_rules, queries  # noqa: F401
from causa.plans.registry import ORACLES, QUERIES
from causa.sources import files


def values(spark, column, rows, schema="v string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_norm_text(spark):
    assert values(spark, text.norm_text(F.col("v")), ["  AÇÃO \n Nº  Ü ", "", None]) == ["acao nº u", "", None]


def test_clean_values(spark):
    assert values(spark, text.clean_null(F.col("v")), ["n/a", " N/A ", "-", "", " x ", None]) == [None, None, None, None, "x", None]
    assert values(spark, text.clean_bool(F.col("v")), ["Sim", "não", "talvez", "TRUE"]) == [True, False, None, True]


def test_money_and_dates(spark):
    assert [str(v) for v in values(spark, text.parse_money(F.col("v")), ["R$ 3.500,00", "1.234.567,8", "sem valor"])] == ["3500.00", "1234567.80", "None"]
    assert values(spark, text.format_money(F.col("v")), [3500.0, 1234567.891], "v double") == ["R$ 3.500,00", "R$ 1.234.567,89"]
    assert values(spark, text.parse_date(F.col("v")), ["15/01/2020", "1/2/2024", "15-01-2020", "2020-01-15", "3 de março de 2024", "32/01/2020", "x"]) == [dt.date(2020, 1, 15), dt.date(2024, 2, 1), dt.date(2020, 1, 15), dt.date(2020, 1, 15), dt.date(2024, 3, 3), None, None]


def test_check_digit(spark):
    assert values(spark, text.check_digit_ok(F.col("v")), ["0001234-58.2023.5.04.0001", "0001234-56.2023.5.04.0001", "nenhum"])[1:] == [False, None]
    digit = 98 - int("0001234" + "2023" + "5" + "04" + "0001" + "00") % 97
    assert values(spark, text.check_digit_ok(F.col("v")), [f"0001234-{digit:02d}.2023.5.04.0001"]) == [True]


def test_canonical_names(spark):
    assert values(spark, text.canonical_name(F.col("v")), ["HORAS EXTRAS 50%", "hora extra", "Férias + 1/3", "FÉRIAS", "13º salário", " Outro "]) == ["Horas Extras", "Horas Extras", "Férias", "Férias", "13º Salário", "Outro"]
    assert values(spark, text.phrase_key(F.col("v")), ["Taxa SELIC", "contrato", "TR", "pagamento de FGTS", "zzz"]) == ["SELIC", None, "TR", "fgts_depositos", None]


def test_plain_format_and_alerts(spark):
    assert values(spark, text.plain_format(F.col("v")), ["123.456.789-01", "12.345.678/0001-95", "2024-03-10", " a   b "]) == ["12345678901", "12345678000195", "10/03/2024", "a b"]
    assert values(spark, text.alert_level(F.col("v")), ["[erro] x", "x"]) == ["ERRO", "AVISO"]
    assert values(spark, text.status_bucket(F.col("v")), ["Indeferida", "deferida", "parcialmente procedente", "?"]) == ["denied", "granted", "partial", "unknown"]


def test_derived_columns(spark):
    assert values(spark, derive.hours_per_day(F.col("v")), ["das 08:00 às 18:00 com 1 h de intervalo", "das 22:00 às 06:00", "das 9h às 9h", "livre"]) == [9.0, 8.0, None, None]
    assert values(spark, derive.divisor(F.col("v")), ["44 horas semanais", "divisor de 180", "42 horas semanais", "-"]) == [220, 180, 210, None]
    day = "a date, b date"
    rows = [(dt.date(2020, 1, 15), dt.date(2023, 6, 30)), (dt.date(2000, 1, 1), dt.date(2023, 1, 1)), (dt.date(2023, 1, 1), dt.date(2023, 2, 14))]
    assert values(spark, derive.notice_days(F.col("a"), F.col("b")), rows, day) == [39, 90, 30]
    assert values(spark, derive.months_worked(F.col("a"), F.col("b")), rows, day) == [42, 276, 1]
    assert values(spark, derive.limitation(F.col("a")), [(dt.date(2024, 2, 29), None)], day) == [dt.date(2019, 2, 28)]


def test_islands_and_blocks(spark):
    a, b = "Assinado eletronicamente por X em 01/02/2024", "Assinado eletronicamente por Y em 05/03/2024"
    rows = [(1, n, {1: "capa", 2: f"RELATÓRIO {a}", 3: f"texto {a}", 4: f"DISPOSITIVO {a}", 5: "nada", 6: f"PROCURAÇÃO {b}", 7: f"VISTOS, {b}", 8: f"JULGO PROCEDENTE {b}", 9: "fim"}[n]) for n in range(1, 10)]
    flags = pages.page_flags(spark.createDataFrame(rows, "doc_id long, page_no int, text string"))
    got = pages.decision_block(flags).collect()
    assert [(r.first_page, r.last_page, r.signed_on) for r in got] == [(2, 4, dt.date(2024, 2, 1))]
    assert [(r.first_page, r.last_page) for r in pages.fallback_block(flags).collect()] == [(7, 9)]
    assert [(r.first_page, r.last_page) for r in pages.last_ruling_block(flags).collect()] == [(7, 9)]
    runs = spark.createDataFrame([(1, n, "2024-01-01") for n in (74, 75, 76, 85, 86)], "doc_id long, page_no int, signed_on string")
    assert {(r.page_no, r.block) for r in pages.islands(runs).collect()} == {(74, 74), (75, 74), (76, 74), (85, 85), (86, 85)}


def test_long_block_is_clipped(spark):
    rows = [(1, n, "DISPOSITIVO" if n in (1, 5) else "x") for n in range(1, 100)]
    flags = pages.page_flags(spark.createDataFrame(rows, "doc_id long, page_no int, text string"))
    assert [(r.first_page, r.last_page) for r in pages.fallback_block(flags).collect()] == [(1, 60)]


def test_field_extraction(spark):
    signed = "Assinado eletronicamente por A em 10/03/2024. Assinado eletronicamente por B em 09/01/2023"
    assert values(spark, fields.latest_date(F.col("v"), catalogs.SIGNED_ON), [signed, "nada"]) == [dt.date(2024, 3, 10), None]
    pay = r"R\$ ([\d.]+,\d{2})"
    assert values(spark, fields.mode_value(F.col("v"), pay, 800, 80_000), ["R$ 3.000,00 R$ 3.500,00 R$ 3.500,00", "R$ 2.000,00 R$ 1.000,00", "R$ 1,00"]) == [3500.0, 2000.0, None]
    docs = spark.createDataFrame([(1, "a@b.co token = \"0123456789abcdef01\""), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.field, r.value) for r in fields.extract_long(docs, catalogs.GENERIC_FIELDS).collect()} == {(1, "email", "a@b.co"), (1, "token", "0123456789abcdef01")}


def test_items(spark):
    rows = [(1, 1, "Horas Extras", "01/2020"), (1, 2, "hora extra", "01/2020"), (1, 3, "Férias", "a"), (1, 4, "Férias", "b")]
    df = spark.createDataFrame(rows, "case_id long, item_no int, name string, period string")
    assert {r.item_no: r.rn for r in items.ranked(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
    assert values(spark, items.percent_near(F.lower("v"), "noturno"), ["adicional noturno de 20%", "nada"]) == [20.0, None]


def test_missing_items(spark):
    granted = spark.createDataFrame([(1, i, n) for i, n in enumerate(["Aaa", "Bbb", "Ccc"])] + [(2, 0, "Aaa")], "case_id long, item_no int, name string")
    calc = spark.createDataFrame([(1, "aaa"), (1, "bbb e reflexos")], "case_id long, name string")
    missing = compare.missing_items(granted, calc)
    assert {(r.case_id, r.name) for r in missing.collect()} == {(1, "Ccc"), (2, "Aaa")}
    near = spark.createDataFrame([(1, "cccc")], "case_id long, name string")
    assert {(r.case_id, r.name) for r in compare.drop_similar(missing, near).collect()} == {(2, "Aaa")}


def test_majority(spark):
    assert values(spark, compare.majority(F.split("v", ",")), ["a,b,b", "a,b", "x"]) == ["b", "a", "x"]


@pytest.mark.parametrize(("a", "b", "least", "most"), [("horas extras", "extras horas", 100, 100), ("dano moral", "dano material", 60, 85), ("", "", 100, 100), ("abc", "xyz", 0, 0)])
def test_token_set(a, b, least, most):
    assert least <= similarity.token_set(a, b) <= most


def test_partial_ratio():
    assert similarity.partial("abc", "xxabcxx") == 100 and similarity.partial("", "x") == 0


def test_rule_lives(spark):
    logs = {"a": [1, 1, 1], "b": [-1], "c": [1, -1, -1], "d": [1, 1, 1, -1, -1], "e": [-1, 1]}
    rows = [(k, i, d) for k, ds in logs.items() for i, d in enumerate(ds)]
    got = {r.k: (r.score, r.status) for r in learning.replay(spark.createDataFrame(rows, "k string, ts int, delta int"), ["k"], ["ts"]).collect()}
    assert got == {"a": (3, "active"), "b": (-1, "deleted"), "c": (-1, "deleted"), "d": (3, "active"), "e": (1, "shadow")}


CASE = """case_id long, hired_on date, left_on date, filed_on date, ruled_on date, book_exit_on date, reais long, number_ok boolean, rate_index string, hours string, notice string, fee string, reason string,
 fund_on_notice string, fund_on_vacation string, fine_on_notice string, deducts boolean, deduction_note string, pay string, book_note string, fund_note string,
 items array<struct<item_no:int,name:string,status:string,period:string,reflex:array<string>,integrates:boolean,amount:double,canonical:string,canonical_key:string>>"""


def day(text):
    return dt.date.fromisoformat(text)


QUIET = {
    "hired_on": day("2018-05-01"), "left_on": day("2020-01-01"), "filed_on": day("2020-06-01"), "ruled_on": day("2021-01-01"), "book_exit_on": day("2020-02-03"), "reais": 5000, "number_ok": True, "rate_index": "IPCA-E", "hours": "44 horas",
    "notice": "30 dias", "fee": "10%", "reason": "com justa causa", "fund_on_notice": "SIM", "fund_on_vacation": "NAO_INCIDE", "fine_on_notice": "INCIDE", "deducts": False, "deduction_note": None, "pay": "R$ 5.000,00", "book_note": None, "fund_note": "", "items": [],
}


def item(name, canonical=None, reflex=(), integrates=False, amount=None, status="deferida", period="p", key=None):
    return (name, status, period, list(reflex), integrates, amount, canonical or name, key or canonical or name)


def alerts_of(spark, cases, catalog=legal_rules.RULES):
    """(level, message) of each case and rule, in order."""
    names = ["case_id", *QUIET]
    rows = []
    for n, own in enumerate(cases):
        v = {**QUIET, **own, "case_id": n}
        rows.append(tuple([(k, *i) for k, i in enumerate(v[c], 1)] if c == "items" else v[c] for c in names))
    found = [{} for _ in cases]
    for r in rules.apply(spark.createDataFrame(rows, CASE), catalog).collect():
        found[r.case_id].setdefault(r.rule_id, []).append((r.level, r.message))
    return found


REST4, ALL4 = ["Férias", "13º Salário", "Aviso Prévio", "FGTS"], ["DSR", "Férias", "13º Salário", "FGTS"]
#: Rule: a case that it fires on with the levels and parts of messages that are due, and a case that it is silent on.
PAIRS = {
    "ADC_58_STF": ({"rate_index": "TR", "hired_on": day("2021-01-01"), "left_on": day("2021-06-01"), "book_exit_on": None, "filed_on": None, "ruled_on": None}, [("AVISO", "TR")], {"rate_index": "IPCA-E e SELIC", "hired_on": day("2021-01-01"), "left_on": day("2021-06-01"), "book_exit_on": None, "filed_on": None, "ruled_on": None}),
    "SUMULA_305_TST": ({"fund_on_notice": None}, [("INFO", "incide")], {"fund_on_notice": "NAO"}),
    "SUMULA_264_TST": ({"items": [item("Horas extras 50%", "Horas Extras", ["DSR"]), item("Horas Extras", period="q")]}, [("INFO", "Férias, 13º Salário, FGTS"), ("INFO", "DSR, Férias, 13º Salário, FGTS")], {"items": [item("Horas Extras", reflex=ALL4)]}),
    "SUMULA_91_TST": ({"pay": "R$ 5.000,00, Remuneracao global"}, [("AVISO", "")], {"hours": "divisor de 200", "pay": None}),
    "OJ_394_SDI1_TST": ({"items": [item("DSR", reflex=["FGTS", "Férias"]), item("Repouso semanal", period="q")]}, [("AVISO", "Férias, FGTS"), ("INFO", "Repouso")], {"items": [item("Saldo de Salário")]}),
    "OJ_195_SDI1_TST": ({"fund_on_vacation": None, "items": [item("Férias indenizadas", "Férias")]}, [("AVISO", "não incide")], {"items": [item("Férias indenizadas", "Férias")]}),
    "OJ_42_SDI1_TST": ({"fine_on_notice": None, "items": [item("Aviso prévio indenizado", "Aviso Prévio")]}, [("AVISO", "não incide")], {"items": [item("Aviso prévio indenizado", "Aviso Prévio")]}),
    "OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS": ({"items": [item("Dano moral", "Dano Moral", ["FGTS", "DSR", "X"])]}, [("ERRO", "DSR"), ("ERRO", "FGTS")], {"items": [item("DSR", reflex=REST4), item("Dano moral", "Dano Moral", ["X"])]}),
    "ART_487_CLT_LEI_12506": ({"notice": "", "hired_on": None}, [("AVISO", "datas")], {"hired_on": None}),
    "ART_791A_CLT": ({"fee": "3%"}, [("AVISO", "abaixo")], {"fee": "10%", "hired_on": day("2015-01-01")}),
    "ART_467_CLT": ({"items": [item("Multa do art. 467")]}, [("AVISO", "")], None),
    "ART_477_CLT": ({"items": [item("Multa do art. 477", amount=5000.0)]}, [("AVISO", "")], None),
    "ART_223G_DANO_EXTRAPATRIMONIAL": ({"reais": 2000, "items": [item("Dano moral", "Dano Moral", amount=a, period=str(a), status=s) for a, s in ((100_001.0, ""), (6000.0, "Deferido"), (None, "deferida"), (9.0, "indeferida"))]}, [("AVISO", "acima"), ("INFO", "leve"), ("INFO", "verificar")], {"items": [item("Dano moral", "Dano Moral", amount=9e9)], "hired_on": day("2017-11-10")}),
    "ART_477A_HOMOLOGACAO": ({"book_note": "A homologacao sindical é NECESSÁRIA"}, [("AVISO", "")], {"reason": "pedido de demissão", "fund_note": "homologação sindical realizada"}),
    "ART_58_ITINERE_REFORMA": ({"items": [item("Horas In Itinere"), item("Tempo de deslocamento", status=""), item("horas trajeto", status="indeferida")]}, [("ERRO", "In Itinere"), ("ERRO", "deslocamento")], {"items": [item("Vale transporte"), item("in itinere", status="indeferida")]}),
    "LEI_12506_2011": ({"notice": "120 dias"}, [("AVISO", "mais de 90")], {}),
    "CONSISTENCIA_AVISO_PREVIO_DIAS": ({"notice": "15 dias"}, [("AVISO", "")], {}),
    "CONSISTENCIA_AVISO_PREVIO_SEM_JUSTA_CAUSA": ({"reason": "sem justa causa", "notice": ""}, [("AVISO", "")], {"reason": "sem justa causa", "notice": "", "items": [item("Aviso Prévio")]}),
    "CONSISTENCIA_BASE_CALCULO_ART_457": ({"items": [item("Intervalo intrajornada"), item("Insalubridade")]}, [("INFO", "")], {"items": [item("Férias"), item("13º salário")]}),
    "CONSISTENCIA_BIS_IN_IDEM_REFLEXOS": ({"items": [item("FGTS", reflex=["FGTS"]), item("DSR", reflex=["DSR"])]}, [("ERRO", "DSR"), ("ERRO", "FGTS")], {"items": [item("FGTS", reflex=["DSR"])]}),
    "CONSISTENCIA_DATAS": ({"hired_on": day("2022-01-01"), "book_exit_on": day("2019-01-01"), "ruled_on": day("2019-12-31")}, [("AVISO", "ajuizamento antes"), ("AVISO", "sentença antes"), ("ERRO", "admissão"), ("ERRO", "ajuizamento depois"), ("ERRO", "CTPS")], {"book_exit_on": None}),
    "CONSISTENCIA_DANO_MORAL_EM_VERBAS": ({"items": [item("Dano moral", "Dano Moral")]}, [("AVISO", "")], {}),
    "CONSISTENCIA_DEDUCAO_AUTORIZADA": ({"deducts": True, "deduction_note": " recibos "}, [("INFO", "autorizada: recibos")], {"deduction_note": "recibos"}),
    "CONSISTENCIA_INTEGRACAO_SEM_REFLEXOS": ({"items": [item("Adicional", integrates=True), item("DSR", reflex=["FGTS"], integrates=True)]}, [("AVISO", "Adicional"), ("AVISO", "DSR")], {"items": [item("Horas Extras", integrates=True), item("Saldo")]}),
    "CONSISTENCIA_MULTA_477_VALOR": ({"items": [item("Multa do art. 477", amount=9.0)]}, [("AVISO", "")], {"items": [item("Multa do art. 477", amount=5100.0)]}),
    "CONSISTENCIA_SALARIO_BASE_MINIMO": ({"reais": 1000}, [("AVISO", "mínimo")], {}),
    "CONSISTENCIA_VERBAS_DUPLICADAS": ({"items": [item("Férias", period="a"), item("férias", "Férias", period=" A "), item("Férias", period="b"), item("FÉRIAS", "Férias", period="a")]}, [("AVISO", "FÉRIAS"), ("AVISO", "férias")], {"items": [item("Férias", period="a"), item("Férias", period="b")]}),
    "CONSISTENCIA_SALARIO": ({"pay": "a apurar", "reais": 0}, [("AVISO", "a apurar")], {"pay": ""}),
    "CNJ_DIGITO_VERIFICADOR": ({"number_ok": False}, [("ERRO", "inválido")], {}),
    "S9_VERBA_DEDUPLICATOR": ({"items": [item("Multa 467 a", "x", key="multa_467"), item("Multa 467 b", "y", key="multa_467")]}, [("AVISO", "Multa 467 b")], {}),
    "BIS_IN_IDEM_VERBAS": ({"items": [item("Horas Extras", reflex=["Horas Extras"])]}, [("ERRO", "Horas Extras")], {"items": [item("Horas Extras")]}),
}


def test_every_rule_fires_and_stays_silent(spark):
    assert {r.id for r in legal_rules.RULES} == set(PAIRS) and len(legal_rules.RULES) == 31
    found = alerts_of(spark, [x if x is not None else {} for fires, _, silent in PAIRS.values() for x in (fires, silent)])
    for n, (rule, (_, due, silent)) in enumerate(PAIRS.items()):
        got = sorted(found[2 * n].get(rule, []))
        assert [g[0] for g in got] == [d[0] for d in sorted(due)] and all(any(level == a and part in b for a, b in got) for level, part in due), (rule, got)
        if silent is None:  # says INFO where it has nothing to warn of
            assert [x[0] for x in found[2 * n + 1][rule]] == ["INFO"]
        else:
            assert rule not in found[2 * n + 1], (rule, found[2 * n + 1])
    # what is silent on a case without faults
    quiet = alerts_of(spark, [{}])[0]
    assert set(quiet) == {"ART_467_CLT", "ART_477_CLT", "ART_791A_CLT"}


#: Strict rule: a case with the alerts that are due, and cases that it is silent on.
STRICT = {
    "SUMULA_305_TST": ({"fund_on_notice": "Não incide"}, [("AVISO", "deve incidir")], [{"fund_on_notice": None}, {"fund_on_notice": "NAO"}, {}]),
    "SUMULA_264_TST": (
        {"items": [item("Horas extras 50%", "Horas Extras", ["FGTS"]), item("hora extra", "Horas Extras", integrates=None), item("horas extras", reflex=["Descanso semanal"], integrates=True)]},
        [("AVISO", "hora extra sem DSR")],
        [{"items": [item("Horas extras", integrates=True, reflex=["DSR"])]}, {"items": [item("Horas extras", integrates=False)]}, {"items": [item("Férias", integrates=True)]}],
    ),
    "OJ_394_SDI1_TST": (
        {"items": [item("Descanso semanal remunerado", reflex=["Férias", "Aviso Prévio", "FGTS"])]},
        [("ERRO", "em fgts"), ("ERRO", "em férias")],
        [{"items": [item("DSR", reflex=["Aviso Prévio"]), item("Horas Extras", reflex=["FGTS"])]}],
    ),
    "OJ_195_SDI1_TST": ({"fund_on_vacation": "Incide"}, [("ERRO", "férias")], [{"fund_on_vacation": "NAO_INCIDE"}, {"fund_on_vacation": None}]),
    "OJ_42_SDI1_TST": ({"fine_on_notice": "sim"}, [("ERRO", "aviso")], [{"fine_on_notice": "não incide"}, {"fine_on_notice": None}]),
    "ART_791A_CLT": ({"fee": "honorários de 15,5 %"}, [("AVISO", "acima")], [{"fee": "20%", "hired_on": day("2017-11-10")}, {"fee": "15"}, {"fee": "5%"}, {"fee": None}]),
    "CONSISTENCIA_DATAS": (
        {"hired_on": day("2022-01-01"), "left_on": day("2021-06-01"), "filed_on": day("2021-05-01")},
        [("AVISO", "admissão depois do ajuizamento"), ("AVISO", "demissão depois"), ("ERRO", "admissão depois da demissão"), ("ERRO", "ajuizamento depois")],
        [{}, {"hired_on": None, "left_on": None}],
    ),
}


def test_strict_rules_fire_and_stay_silent(spark):
    assert {r.id for r in legal_rules.STRICT_RULES} == set(STRICT)
    clear = {"fine_on_notice": None}
    for rule, (fires, due, silent) in STRICT.items():
        found = alerts_of(spark, [{**clear, **x} for x in (fires, *silent)], legal_rules.STRICT_RULES)
        got = sorted(found[0][rule])
        assert [g[0] for g in got] == [d[0] for d in due] and all(any(level == a and part in b for a, b in got) for level, part in due), (rule, got)
        assert all(rule not in f for f in found[1:]), (rule, found)


def test_repeated_tails(spark):
    notice, ruling, label = catalogs.REPEAT_NOTICE, catalogs.REPEAT_RULING, catalogs.PAGE_LABEL
    far = "x" * 400
    rows = [
        "corpo JULGO PROCEDENTE \n CERTIDÃO de disponibilização e publicação JULGO PROCEDENTE",
        "--- PÁGINA 1\nante o exposto, a\n\n--- PÁGINA 2\nb JULGO PROCEDENTE c",
        f"--- PÁGINA 1\nante o exposto, a {far} JULGO PROCEDENTE c",
        "--- PÁGINA 1 ANTE O EXPOSTO, fim ",
        "", None, "JULGO PROCEDENTEISTO POSTO,",
    ]
    want = ["corpo JULGO PROCEDENTE", "--- PÁGINA 1\nante o exposto, a", f"--- PÁGINA 1\nante o exposto, a {far}", rows[3], "", None, "JULGO PROCEDENTE"]
    assert values(spark, text.cut_repeat(F.col("v"), notice, ruling, label), rows) == want


def test_higher_rules_change_what_later_ones_read(spark):
    got = alerts_of(spark, [{"items": [item("DSR", reflex=REST4, integrates=True), item("Horas Extras", integrates=True)]}])[0]
    assert [x[0] for x in got["OJ_394_SDI1_TST"]] == ["AVISO"] and "OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS" not in got
    assert [m for _, m in got["CONSISTENCIA_INTEGRACAO_SEM_REFLEXOS"]] == ["DSR sem reflexos"]


def test_rules_are_date_bounded(spark):
    rule = rules.Rule("R", "t", "b", 10, (("true", "INFO", "'m'"),), since="2020-01-01")
    cases = spark.createDataFrame([(1, dt.date(2019, 12, 31)), (2, dt.date(2020, 1, 1)), (3, None)], "case_id long, hired_on date")
    assert {r.case_id for r in rules.apply(cases, [rule]).collect()} == {2, 3}


def test_mixed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes("<é/>".encode())
    (tmp_path / "b.txt").write_bytes("ação".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("ção".encode("latin-1"))
    got = {r.suffix: r.text for r in files.read_mixed(spark, str(tmp_path)).collect()}
    assert got == {"xml": "<é/>", "txt": "ação", "csv": "ção"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], "2024-01-01")], "id long, names array<string>, dt string")
    files.write_runs(rows, str(tmp_path / "runs"))
    files.append_json(rows, str(tmp_path / "log"))
    files.append_json(rows, str(tmp_path / "log"))
    files.write_sheet(rows, str(tmp_path / "sheet"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 1 and spark.read.json(str(tmp_path / "log")).count() == 2
    assert spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "sheet")).first()["names"].startswith("[")


def test_partitions_do_not_change_results(spark):
    one = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(repr, QUERIES["item_dedup"](spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(repr, QUERIES["item_dedup"](spark, "/root/testdata/sf0.001").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", one)


def test_replay_by_stretches_is_replay_as_a_whole(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([1, 1, -1, -1, -1] if k % 2 else [1, -1])) for k in range(60) for i in range(rng.randint(1, 40))] + [(99, i, d) for i, d in enumerate([1, -99, -1, 1, 1])]
    df = spark.createDataFrame(rows, "k long, ts int, delta int")
    want = {}
    for k, _, d in rows:
        score, status, hits, bad = want.get(k, (0, "shadow", 0, 0))
        hits, bad = hits + (d > 0), bad + (d < 0)
        if not (d < 0 and status in ("active", "deleted")):
            born = status == "deleted"
            score = 1 if born else score + d
            status = "active" if score >= 3 else "deleted" if score <= -1 else "shadow" if born else status
        want[k] = score, status, hits, bad
    for width in (1, 3, 1000):
        got = {r.k: (r.score, r.status, r.hits, r.punished) for r in learning.replay(df, ["k"], ["ts"], F.floor(F.col("ts") / width)).collect()}
        assert got == want


def test_common_subsequences_match_a_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 30))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert similarity._common(a, b) == rows[-1][-1]


def test_no_resembling_line_is_sorted_out(spark):
    rng, phrase = random.Random(3), "all rights reserved"
    lines = ["", "a", "all", "al rigths reservd", "x" * 500 + " all rights reserved " + "y" * 900, "ALL".lower(), "rights reserve", "nothing like it"]
    for _ in range(400):
        own = list(phrase[: rng.randint(8, 19)])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choices("abre ", k=rng.randint(0, 1))
            own = own or ["a"]
        lines.append("".join(rng.choices("xyz ", k=rng.randint(0, 40))) + "".join(own) + "".join(rng.choices("xyz ", k=rng.randint(0, 40))))
    df = spark.createDataFrame([(x, phrase) for x in lines], "line string, phrase string")
    kept = {r.line for r in df.where(similarity.may_resemble(F.col("line"), F.col("phrase"))).collect()}
    due = {x for x in lines if similarity.partial(x, phrase) >= 85}
    assert due <= kept and len(due) > 50 and "nothing like it" not in kept


def test_only_xml_is_cut(spark, tmp_path, monkeypatch):
    for name in ("a.xml", "b.txt", "c.html", "d.csv"):
        (tmp_path / name).write_text("é" * 50, encoding="latin-1" if name == "d.csv" else "utf-8")
    monkeypatch.setattr(files, "LONGEST", 10)
    assert {r.suffix: r.text for r in files.read_mixed(spark, str(tmp_path)).collect()} == {"xml": "é" * 10, "txt": "é" * 50, "html": "é" * 50, "csv": "é" * 50}


def test_amounts_by_variant_and_short_years(spark):
    said = ["pago R$ 1.234,56 em 3 vezes", "-10,50", "R$ 7", "nada"]
    got = {v: [None if x is None else float(x) for x in values(spark, text.parse_money(F.col("v"), v), said)] for v in ("first", "marked", "signed")}
    assert got == {"first": [1234.56, -10.5, 7.0, None], "marked": [1234.56, None, None, None], "signed": [None, -10.5, None, None]}
    assert float(values(spark, text.parse_money(F.col("v"), "digits"), ["R$ 1.234,56 !"])[0]) == 1234.56
    dates = values(spark, text.parse_date(F.col("v")), ["01/02/95", "1/2/20", "31/12/68", "01/01/69", "01/02/1995"])
    assert dates == [dt.date(1995, 2, 1), dt.date(2020, 2, 1), dt.date(2068, 12, 31), dt.date(1969, 1, 1), dt.date(1995, 2, 1)]


def test_xml_files_are_read_once(spark):
    from causa.plans import reports

    found = reports.calc_critical_check(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("XPathStringEvaluator") == 1


def test_resembles_equals_the_plain_score(spark):
    """Also for lines without a full window, wide letters and windows that would cross two lines."""
    rng = random.Random(3)
    phrase = "licensed under the terms"
    lines = ["", "a", "licensed", "under the", "licensed under the terms", "licensed under", "the terms", "x licensed vnder the tems of", "licença sob os termos 😀", None, "z" * 40]
    lines += ["".join(rng.choice(phrase) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    lines += [(lambda t: t[:k] + rng.choice("xyz e") + t[k + rng.randint(0, 2) :])(f"so {phrase} of") for k in range(26) for _ in range(4)]
    rows = spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).select("v", similarity.resembles(F.col("v"), phrase).alias("got")).collect()
    assert [r.got for r in rows] == [bool(x) and similarity.partial(x, phrase) >= 85 for x in lines]


def test_reflexes_that_are_unknown_silence_no_other_rule(spark):
    bare = ("DSR", "deferida", "p", None, True, None, "DSR", "DSR")
    got = alerts_of(spark, [{"items": [bare, item("Multa do art. 477", "Multa Art. 477 CLT", ["FGTS"])]}])[0]
    assert got["ART_477_CLT"] == [("AVISO", "multa deferida")] and [x for x, _ in got["OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS"]] == ["ERRO"]


def test_rules_are_columns_before_they_are_exploded(spark):
    found = rules.apply(spark.createDataFrame([], CASE), legal_rules.RULES)
    made = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert made and not any("CASE" in x or "RLIKE" in x for x in made)


def test_values_of_texts_by_either_join(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "n int, t string")
    for few in (20_000, 1):
        got = items.with_values(rows, "t", few, u=F.upper("t"))
        assert sorted((r.n, r.t, r.u) for r in got.collect()) == [(1, "a", "A"), (2, "b", "B"), (3, "a", "A"), (4, None, None)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_check_digit_reads_the_number_once(spark):
    df = spark.createDataFrame([("0001234-58.2023.5.04.0001",)], "v string").select(text.check_digit_ok(F.col("v")).alias("ok"))
    assert plan_of(df).lower().count("regexp_extract(") == 1


def test_rows_of_items_do_not_carry_the_whole_case():
    conditions = [c for r in (*legal_rules.RULES, *legal_rules.STRICT_RULES) for c in (*(o[0] for o in r.outcomes), *(o[0] for o in r.item_outcomes))]
    assert conditions and not [c for c in conditions if re.search(r"\bitems\b", c)]


def test_repeated_items_without_period_or_key(spark):
    rows = [item("Horas Extras"), item("Horas Extras"), item("FGTS", period=None), item("FGTS", period=None), item("Horas Extras", period=" X "), item("Horas Extras", period="x")]
    found = alerts_of(spark, [{"items": rows}])[0]["CONSISTENCIA_VERBAS_DUPLICADAS"]
    assert len(found) == 2, found


def test_missing_items_are_computed_once_to_drop_similar_ones(spark):
    missing = spark.createDataFrame([(1, 1, "Bonus anual", "bonus anual"), (2, 1, "Outra", "outra"), (3, 1, "Sem lista", "sem lista")], "case_id long, item_no int, name string, low string")
    got = compare.drop_similar(missing, spark.createDataFrame([(1, "Bonus anual pago"), (1, None), (2, "Vale"), (4, "Outra")], "case_id long, name string"))
    assert {(r.case_id, r.name) for r in got.collect()} == {(2, "Outra"), (3, "Sem lista")}
    assert "LogicalRDD" not in plan_of(got) and "LocalRelation" not in plan_of(got)


def test_calculation_files_are_read_as_by_xpath(spark):
    files_of = [
        "<calculo><indice>SELIC</indice><divisor>220</divisor><verba><nome>A &amp; B </nome></verba><verba><nome> á<x>in</x>fim</nome><nome/></verba></calculo>",
        "<calculo><divisor> 2<b>0</b> </divisor><divisor>1</divisor><c><verba><nome>D</nome></verba></c><nome>E</nome></calculo>", "<verba><nome>F</nome></verba>", "<calculo/>", None,
    ]
    df = spark.createDataFrame([(x,) for x in files_of], "xml string")
    paths = [F.expr(e) for e in ("xpath_string(xml, '/calculo/indice')", "xpath_string(xml, '/calculo/divisor')", "xpath(xml, '//verba/nome/text()')")]
    assert [tuple(r) for r in df.select(calculation.read(F.col("xml")).alias("c")).select("c.*").collect()] == [tuple(r) for r in df.select(*paths).collect()]


def test_repeated_tails_are_sought_once(spark):
    df = spark.createDataFrame([("x",)], "v string").select(text.cut_repeat(F.col("v"), catalogs.REPEAT_NOTICE, catalogs.REPEAT_RULING, catalogs.PAGE_LABEL).alias("kept"))
    assert plan_of(df).lower().count("regexp_instr(") == 3


def test_backfill_cuts_only_texts_of_cases_without_items(spark, tmp_path):
    for t, where in (("orders", "true"), ("lineitem", "l_orderkey % 5 <> 0")):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where(where).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["item_backfill"](spark, str(tmp_path))
    got = sorted(map(tuple, df.select("case_id", "pos", "item", "origin").collect()))
    assert got == sorted(con.execute(f"SELECT case_id, pos, item, origin FROM ({ORACLES['item_backfill']})").fetchall()) and any(r[3] == "text" for r in got)
    assert plan_of(df).index("Generate") < plan_of(df).index("LeftSemi")


def test_backfill_takes_what_is_granted_else_the_names_in_the_text(spark):
    texts = [
        (1, "Defiro o DSR.\nFérias vencidas; JULGO procedente o pedido de  aviso  prévio. Rejeito o dano moral."),
        (2, "Indefiro as horas extras. Multa do art. 477 e horas extras, hora extra; 13º; contrato"),
        (3, "Defiro em parte as FÉRIAS VENCIDAS, mas afasto a dobra;defiro 13º salário"), (4, "nada"), (5, None), (6, "Condenada ao contrato; devo pagar"),
    ]
    got = sorted(map(tuple, cases.items_in(spark.createDataFrame(texts, "case_id long, text string")).collect()))
    assert got == [
        (1, 1, "dsr", "text"), (1, 3, "aviso_previo_indenizado", "text"),
        (2, 1, "Multa Art. 477 CLT", "alias"), (2, 2, "13º Salário Proporcional", "alias"), (2, 3, "Horas Extras", "alias"),
        (3, 1, "ferias_vencidas", "text"), (3, 2, "decimo_terceiro", "text"),
    ]


def test_rule_catalog_faults(spark):
    fires = (("true", "INFO", "'x'"),)
    made = [
        rules.Rule("A", "t", "b", 10, fires), rules.Rule("B", "t", "b", 20, (), "2017-11-11", item_outcomes=(("array('x')", "INFO"),)), rules.Rule("", "", "", 0, ()),
        rules.Rule("C", "t", "b", -1, fires, "2017-13-01"), rules.Rule("D", "t", "b", 10, fires, "11/11/2017"), rules.Rule("D", "u", None, 30, fires), rules.Rule("E", "t", "b", None, fires, "2017"),
    ]
    got = sorted((r.rule_id, r.faults) for r in rules.checked(rules.metadata(spark, made)).collect())
    assert got == [("", "id,title,basis,priority,outcomes"), ("A", ""), ("B", ""), ("C", "priority,since"), ("D", "basis,repeated"), ("D", "since,repeated"), ("E", "priority,since")]


def test_calculation_files_are_read_wherever_a_value_stands(spark):
    files_of = [
        "<root><x><juros>A</juros></x><ParametrosDeAtualizacao><indiceTrabalhista> IPCAE </indiceTrabalhista><juros>TRD_SIMPLES</juros></ParametrosDeAtualizacao><Verba><nome> Férias </nome><nome>B</nome></Verba><nome>C</nome></root>",
        "<root><ParametrosDeAtualizacao><juros/></ParametrosDeAtualizacao><a><indiceTrabalhista>TRD</indiceTrabalhista></a><y><valorCargaHorariaPadrao>220,50</valorCargaHorariaPadrao></y><i><nome>D</nome></i><nome> </nome><i><nome>D </nome><nome>E</nome></i></root>",
        "<calculo><indice>SELIC</indice><divisor>x</divisor><verba><nome>F</nome></verba><verba><nome>G</nome></verba><verba><nome>F</nome></verba></calculo>", "<root/>", None,
    ]
    df = spark.createDataFrame([(x,) for x in files_of], "xml string").select(calculation.basics(F.col("xml")).alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [
        ("IPCAE", "TRD_SIMPLES", None, ["Férias"]), ("TRD", None, 220.5, ["D", "E"]), ("SELIC", None, None, ["F", "G"]), (None, None, None, []), (None, None, None, None),
    ]
