"""The built-in rules as data, each condition of a case beside the SQL that it is compared with.

Spark conditions read the case with its nested items; the others read flags that
the comparison aggregates from the item table. Conditions of items are compared
with joins over the item and reflex rows (see cases).

Rules of a higher rank change what later ones read: overtime gets the reflexes
that are due, weekly rest loses those that it may not have.
"""

from __future__ import annotations

from causa.operators.rules import CONSISTENCY, GUIDANCE, LAW, STATUTE_CASES, SUPREME, Rule

REFORM = "2017-11-11"


def _has(pattern: str) -> str:
    return f"item_names rlike r'(?iu){pattern}'"


_FEE = "try_cast(regexp_extract(fee, r'^([0-9]+)', 1) as int)"
_FEE_SQL = "try_cast(nullif(regexp_extract(fee, '^([0-9]+)', 1), '') AS INT)"
_DAYS = "try_cast(regexp_extract(notice, r'^([0-9]+)', 1) as int)"
_DAYS_SQL = "try_cast(nullif(regexp_extract(notice, '^([0-9]+)', 1), '') AS INT)"
# Reflexes that overtime must have, that weekly rest may not have, and pairs of items and reflexes that are barred.
DUE = ("DSR", "Férias", "13º Salário", "FGTS")
NOT_OF_REST = ("Férias", "13º Salário", "Aviso Prévio", "FGTS")
_NOT_OF_FINES = ("DSR", "Férias", "13º Salário", "FGTS", "Aviso Prévio")
BARRED = {
    "DSR": ("Férias", "13º Salário", "FGTS"),
    "Multa Art. 467 CLT": _NOT_OF_FINES,
    "Multa Art. 477 CLT": _NOT_OF_FINES,
    "Dano Moral": _NOT_OF_FINES,
    "Dano Material": _NOT_OF_FINES,
    "Aviso Prévio": ("Aviso Prévio",),
}
BASE = r"horas?\s*extras?|adicional\s*noturno|insalubridade|periculosidade|intervalo\s*intrajornada"
DAMAGE = r"danos?\s*mora(l|is)|danos?\s*extrapatrimonia(l|is)"


def _array(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


_OVERTIME = "contains(lower(i.name), 'horas extras')"
_REST = "(contains(lower(i.name), 'dsr') or contains(lower(i.name), 'repouso semanal'))"
_ADDED = f"if({_OVERTIME}, array_except({_array(DUE)}, i.reflex), cast(array() as array<string>))"
_REMOVED = f"if({_REST}, array_intersect({_array(NOT_OF_REST)}, i.reflex), cast(array() as array<string>))"
#: Values that several rules read, in the order in which one reads another; the rules name them.
_BARRED = f"array_intersect(case i.canonical {' '.join(f"when '{n}' then {_array(r)}" for n, r in BARRED.items())} else cast(array() as array<string>) end, left_over)"
_ITEM_VALUES = (
    ("low_name", "lower(i.name)"), ("added", _ADDED.replace("lower(i.name)", "low_name")), ("removed", _REMOVED.replace("lower(i.name)", "low_name")), ("left_over", "array_except(concat(i.reflex, added), removed)"), ("barred", _BARRED),
    ("damages", f"lower(i.status) in ('deferida', 'deferido', '') and i.name rlike r'(?iu){DAMAGE}'"),
)
_TIMES = "i.amount / reais"


def _when(condition: str, message: str) -> str:
    return f"if({condition}, array({message}), cast(array() as array<string>))"


_ALWAYS = "true"
# Wordings of all-in pay, of a demand for union approval, and of commuting time.
ALL_IN_PAY = ("salario complessivo", "remuneracao global", "salario global", "tudo incluído", "ja incluidas todas", "engloba todos")
APPROVAL = r"homologa[çc][aã]o\s+sindical\s+(é\s+|e\s+)?obrigat[oó]ria|homologa[çc][ãa]o\s+sindical\s+exigida|rescis[aã]o\s+condicionada\s+a\s+homologa[çc][aã]o|validade\s+da\s+rescis[aã]o\s+depende\s+de\s+homologa[çc][aã]o|nulidade\s+(da\s+rescis[aã]o\s+)?por\s+falta\s+de\s+homologa[çc][aã]o|homologa[çc][aã]o\s+sindical\s+(é\s+|e\s+)?necess[aá]ria"
COMMUTE = r"in\s*itinere|horas?\s*de\s*deslocamento|percurso\s*casa\s*trabalho|tempo\s*de\s*deslocamento|horas?\s*trajet"
_ALL_IN = f"concat_ws(' ', pay, hours) rlike r'(?iu){'|'.join(ALL_IN_PAY)}'"
_ALL_IN_SQL = f"regexp_matches(concat_ws(' ', pay, hours), '(?i){'|'.join(ALL_IN_PAY)}')"
_NOTES = ("reason", "book_note", "fund_note")
_APPROVAL = " or ".join(f"coalesce({n}, '') rlike r'(?iu){APPROVAL}'" for n in _NOTES)
_APPROVAL_SQL = " OR ".join(f"regexp_matches(coalesce({n}, ''), '(?i){APPROVAL}')" for n in _NOTES)
#: SQL of the amount that a salary text names: digits with points between thousands and a comma before cents.
PAID = "try_cast(replace(replace(nullif(regexp_extract(pay, r'([0-9][0-9.]*(?:,[0-9]+)?)', 1), ''), '.', ''), ',', '.') as double)"
_UNREAD = f"trim(pay) <> '' and {PAID} is null"
_UNREAD_SQL = _UNREAD.replace("r'", "'")
_TR = "contains(lower(rate_index), 'tr') and not contains(lower(rate_index), 'ipca')"

#: The names of all items are one text, parted by a letter that no pattern takes.
_FINE = "if(contains(array_join(items.name, chr(1)), '477'), array_max(transform(filter(items, i -> contains(i.name, '477')), i -> i.amount)), null)"


def _holds(*words: str) -> str:
    """Whether one item's name holds all words; the names are gone through one by one only where they hold the first at all."""
    return f"contains(lower(array_join(items.name, chr(1))), '{words[0]}') and exists(items, i -> {' and '.join(f"contains(lower(i.name), '{w}')" for w in words)})"


def _keys(of: str) -> str:
    return f"transform(items, i -> length(i.{of}) || ':' || i.{of} || lower(trim(i.period)))"


def _repeats(keys: str) -> str:
    """Per item, whether an earlier one has its key."""
    return f"transform({keys}, (x, k) -> array_position({keys}, x) <= k)"


#: All that reads the array of items is computed before the case is taken apart, so that its rows needn't carry the array.
_CASE_VALUES = (
    ("notice_given", _DAYS), ("fee_given", _FEE), ("item_names", "array_join(items.name, chr(1))"), ("paid_vacation", _holds("indenizada", "férias")), ("paid_notice", _holds("indenizado", "aviso")), ("fine", _FINE),
    ("name_keys", _keys("canonical")), ("key_keys", _keys("canonical_key")), ("name_repeats", _repeats("name_keys")), ("key_repeats", _repeats("key_keys")),
)

#: id, title, basis, priority, applies to hirings since, outcomes of (condition, comparison, level, message);
#: a message that begins with a quote is SQL
CATALOG = (
    ("ADC_58_STF", "Índice de correção", "ADC 58 STF", SUPREME, "2020-12-18", (
        (_TR, _TR, "AVISO", "TR afastada"),)),
    ("SUMULA_305_TST", "FGTS sobre aviso prévio", "Súmula 305 TST", STATUTE_CASES, None, (("fund_on_notice is null", "fund_on_notice IS NULL", "INFO", "FGTS incide sobre o aviso"),)),
    ("SUMULA_264_TST", "Reflexos de horas extras", "Súmula 264 TST", STATUTE_CASES, None, ()),
    ("SUMULA_91_TST", "Salário complessivo", "Súmula 91 TST", STATUTE_CASES, None, ((_ALL_IN, _ALL_IN_SQL, "AVISO", "parcela sem discriminação"),)),
    ("OJ_394_SDI1_TST", "DSR sem repercussão", "OJ 394 SDI-1 TST", GUIDANCE, None, ()),
    ("OJ_195_SDI1_TST", "FGTS sobre férias indenizadas", "OJ 195 SDI-1 TST", GUIDANCE, None, (
        ("fund_on_vacation is null and paid_vacation", "fund_on_vacation IS NULL AND paid_vacation", "AVISO", "não incide"),
        ("fund_on_vacation is null", "fund_on_vacation IS NULL", "INFO", "não aplicável"))),
    ("OJ_42_SDI1_TST", "Multa de 40% e aviso", "OJ 42 SDI-1 TST", GUIDANCE, None, (
        ("fine_on_notice is null and paid_notice", "fine_on_notice IS NULL AND paid_notice", "AVISO", "não incide"),
        ("fine_on_notice is null", "fine_on_notice IS NULL", "INFO", "incide"))),
    ("OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS", "Reflexos proibidos", "OJ 394 SDI-1 TST", GUIDANCE, None, ()),
    ("ART_487_CLT_LEI_12506", "Aviso proporcional", "Art. 487 CLT", LAW, None, (
        ("notice_given is null and (hired_on is null or left_on is null)", f"{_DAYS_SQL} IS NULL AND (hired_on IS NULL OR left_on IS NULL)", "AVISO", "datas ausentes"), ("notice_given is null", f"{_DAYS_SQL} IS NULL", "INFO", "aviso calculado"))),
    ("ART_791A_CLT", "Honorários", "Art. 791-A CLT", LAW, REFORM, (
        ("fee_given is null", f"{_FEE_SQL} IS NULL", "INFO", "sem percentual"), ("fee_given < 5", f"{_FEE_SQL} < 5", "AVISO", "abaixo de 5%"),
        ("fee_given > 15", f"{_FEE_SQL} > 15", "AVISO", "acima de 15%"), (_ALWAYS, "true", "INFO", "entre 5% e 15%"))),
    ("ART_467_CLT", "Multa do art. 467", "Art. 467 CLT", LAW, None, ((_has("467"), "has_467", "AVISO", "multa deferida"), (_ALWAYS, "true", "INFO", "sem multa"))),
    ("ART_477_CLT", "Multa do art. 477", "Art. 477 CLT", LAW, None, ((_has("477"), "has_477", "AVISO", "multa deferida"), (_ALWAYS, "true", "INFO", "sem multa"))),
    ("ART_223G_DANO_EXTRAPATRIMONIAL", "Faixa do dano", "Art. 223-G CLT", LAW, REFORM, ()),
    ("ART_477A_HOMOLOGACAO", "Homologação sindical", "Art. 477-A CLT", LAW, REFORM, ((_APPROVAL, _APPROVAL_SQL, "AVISO", "homologação dispensada"),)),
    ("ART_58_ITINERE_REFORMA", "Horas in itinere", "Art. 58 CLT", LAW, REFORM, ()),
    ("LEI_12506_2011", "Limites do aviso", "Lei 12.506/2011", LAW, None, (("notice_given < 30", f"{_DAYS_SQL} < 30", "AVISO", "menos de 30 dias"), ("notice_given > 90", f"{_DAYS_SQL} > 90", "AVISO", "mais de 90 dias"))),
    ("CONSISTENCIA_AVISO_PREVIO_DIAS", "Dias de aviso", "Consistência", CONSISTENCY, None, (("notice_given < 30 or notice_given > 90", f"{_DAYS_SQL} < 30 OR {_DAYS_SQL} > 90", "AVISO", "dias fora dos limites"),)),
    ("CONSISTENCIA_AVISO_PREVIO_SEM_JUSTA_CAUSA", "Aviso sem justa causa", "Consistência", CONSISTENCY, None, (
        ("reason = 'sem justa causa' and notice = '' and not " + _has(r"aviso\s*pr[eé]vio"), "reason = 'sem justa causa' AND notice = '' AND NOT coalesce(has_notice, false)", "AVISO", "aviso ausente"),)),
    ("CONSISTENCIA_BASE_CALCULO_ART_457", "Base de cálculo", "Art. 457 CLT", CONSISTENCY, None, ((_has(BASE), "has_base", "INFO", "base conforme art. 457"),)),
    ("CONSISTENCIA_BIS_IN_IDEM_REFLEXOS", "Reflexo sobre si", "Consistência", CONSISTENCY, None, ()),
    ("CONSISTENCIA_DATAS", "Ordem das datas", "Consistência", CONSISTENCY, None, (
        ("book_exit_on < left_on", "book_exit_on < left_on", "ERRO", "saída na CTPS antes da demissão"), ("hired_on > left_on", "hired_on > left_on", "ERRO", "admissão depois da demissão"),
        ("ruled_on < left_on", "ruled_on < left_on", "AVISO", "sentença antes da demissão"), ("filed_on > ruled_on", "filed_on > ruled_on", "ERRO", "ajuizamento depois da sentença"),
        ("filed_on < hired_on", "filed_on < hired_on", "AVISO", "ajuizamento antes da admissão"))),
    ("CONSISTENCIA_DANO_MORAL_EM_VERBAS", "Dano moral entre verbas", "Consistência", CONSISTENCY, None, ((_has(r"dano\s*moral"), "has_damage", "AVISO", "dano moral entre verbas"),)),
    ("CONSISTENCIA_DEDUCAO_AUTORIZADA", "Dedução", "Consistência", CONSISTENCY, None, (
        ("deducts and trim(deduction_note) <> ''", "deducts AND trim(deduction_note) <> ''", "INFO", "'dedução autorizada: ' || trim(deduction_note)"), ("deducts", "deducts", "INFO", "dedução autorizada"))),
    ("CONSISTENCIA_INTEGRACAO_SEM_REFLEXOS", "Integração sem reflexos", "Consistência", CONSISTENCY, None, ()),
    ("CONSISTENCIA_MULTA_477_VALOR", "Valor da multa", "Art. 477 CLT", CONSISTENCY, None, (("abs(fine - reais) > 0.05 * reais", "abs(fine - reais) > 0.05 * reais", "AVISO", "multa difere do salário"),)),
    ("CONSISTENCIA_SALARIO_BASE_MINIMO", "Salário mínimo", "Consistência", CONSISTENCY, None, (("reais <= 0", "reais <= 0", "ERRO", "salário não positivo"), ("reais < 1518", "reais < 1518", "AVISO", "abaixo do mínimo"))),
    ("CONSISTENCIA_VERBAS_DUPLICADAS", "Verbas repetidas", "Consistência", CONSISTENCY, None, ()),
    ("CONSISTENCIA_SALARIO", "Salário plausível", "Consistência", CONSISTENCY, None, ((_UNREAD, _UNREAD_SQL, "AVISO", "'não interpretável: ' || pay"), ("reais <= 0", "reais <= 0", "ERRO", "não positivo"), ("reais < 1518", "reais < 1518", "AVISO", "baixo"), ("reais > 100000", "reais > 100000", "AVISO", "alto"))),
    ("CNJ_DIGITO_VERIFICADOR", "Dígito verificador", "Numeração única", CONSISTENCY, None, (("number_ok is null", "number IS NULL", "INFO", "número ausente"), ("not number_ok", "case_id % 7 = 0", "ERRO", "dígito inválido"))),
    ("S9_VERBA_DEDUPLICATOR", "Chaves repetidas", "Consistência", CONSISTENCY, None, ()),
    ("BIS_IN_IDEM_VERBAS", "Bis in idem", "Consistência", CONSISTENCY, None, ()),
)

#: Rules of which all outcomes that hold count.
EVERY = ("CONSISTENCIA_DATAS",)
#: Rule: outcomes of (messages of the item i, level), an alert per message.
ITEM_OUTCOMES = {
    "SUMULA_264_TST": ((_when("size(added) > 0", "i.name || ' + ' || array_join(added, ', ')"), "INFO"),),
    "OJ_394_SDI1_TST": (
        (_when("size(removed) > 0", "i.name || ' - ' || array_join(removed, ', ')"), "AVISO"),
        (_when(f"{_REST.replace('lower(i.name)', 'low_name')} and size(removed) = 0", "i.name || ' verificado'"), "INFO"),
    ),
    "OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS": (("if(size(barred) > 0, transform(barred, r -> i.canonical || ' não reflete em ' || r), cast(array() as array<string>))", "ERRO"),),
    "ART_223G_DANO_EXTRAPATRIMONIAL": tuple(
        (_when(f"damages and {condition}", f"i.name || ': {band}'"), level)
        for condition, band, level in (
            ("(i.amount is null or reais is null or reais <= 0)", "verificar faixa", "INFO"),
            (f"reais > 0 and {_TIMES} <= 3", "leve", "INFO"),
            (f"reais > 0 and {_TIMES} > 3 and {_TIMES} <= 5", "médio", "INFO"),
            (f"reais > 0 and {_TIMES} > 5 and {_TIMES} <= 20", "grave", "INFO"),
            (f"reais > 0 and {_TIMES} > 20 and {_TIMES} <= 50", "gravíssimo", "INFO"),
            (f"reais > 0 and {_TIMES} > 50", "acima de gravíssimo", "AVISO"),
        )
    ),
    "ART_58_ITINERE_REFORMA": ((_when(f"lower(coalesce(i.status, '')) in ('deferida', 'deferido', '') and i.name rlike r'(?iu){COMMUTE}'", "i.name || ' não é jornada'"), "ERRO"),),
    "CONSISTENCIA_BIS_IN_IDEM_REFLEXOS": ((_when("array_contains(left_over, i.canonical)", "i.canonical || ' sobre si'"), "ERRO"),),
    "CONSISTENCIA_INTEGRACAO_SEM_REFLEXOS": ((_when("i.integrates and size(left_over) = 0", "i.canonical || ' sem reflexos'"), "AVISO"),),
    "CONSISTENCIA_VERBAS_DUPLICADAS": ((_when("name_repeats[k]", "i.name || ' repetida'"), "AVISO"),),
    "S9_VERBA_DEDUPLICATOR": ((_when("key_repeats[k]", "i.name || ' repetida'"), "AVISO"),),
    "BIS_IN_IDEM_VERBAS": ((_when("contains(lower(array_join(left_over, chr(1))), lower(i.canonical)) and exists(left_over, r -> lower(r) = lower(i.canonical))", "i.name || ' sobre si'"), "ERRO"),),
}


def message(m: str) -> str:
    """SQL of a catalog message."""
    return m if m.startswith("'") else f"'{m}'"


# Strict variants: other readings of seven of the rules, not part of RULES. They say nothing of a value that is missing.

#: Reflexes that weekly rest may not have, as parts of their lower-cased names.
STRICT_NOT_OF_REST = ("férias", "ferias", "13º", "13 salario", "fgts")
_PERCENT = r"([0-9]+(?:[.,][0-9]+)?)\s*%"
_RATE = f"try_cast(replace(nullif(regexp_extract(fee, r'{_PERCENT}', 1), ''), ',', '.') as double)"
_RATE_SQL = f"try_cast(replace(nullif(regexp_extract(fee, '{_PERCENT}', 1), ''), ',', '.') AS DOUBLE)"


def _denies(field: str) -> str:
    return f"(contains(lower({field}), 'não') or contains(lower({field}), 'nao'))"


def _falls_due(field: str) -> str:
    return f"(contains(lower({field}), 'sim') or contains(lower({field}), 'incide')) and not {_denies(field)}"


_NO_FUND = f"contains(lower(fund_on_notice), 'incide') and {_denies('fund_on_notice')}"

STRICT_CATALOG = (
    ("SUMULA_305_TST", "FGTS sobre aviso prévio", "Súmula 305 TST", STATUTE_CASES, None, ((_NO_FUND, _NO_FUND, "AVISO", "FGTS deve incidir sobre o aviso"),)),
    ("SUMULA_264_TST", "DSR entre os reflexos de horas extras", "Súmula 264 TST", STATUTE_CASES, None, ()),
    ("OJ_394_SDI1_TST", "DSR sem repercussão", "OJ 394 SDI-1 TST", GUIDANCE, None, ()),
    ("OJ_195_SDI1_TST", "FGTS sobre férias indenizadas", "OJ 195 SDI-1 TST", GUIDANCE, None, ((_falls_due("fund_on_vacation"), _falls_due("fund_on_vacation"), "ERRO", "FGTS não incide sobre férias indenizadas"),)),
    ("OJ_42_SDI1_TST", "Multa de 40% e aviso", "OJ 42 SDI-1 TST", GUIDANCE, None, ((_falls_due("fine_on_notice"), _falls_due("fine_on_notice"), "ERRO", "multa não incide sobre o aviso"),)),
    ("ART_791A_CLT", "Honorários", "Art. 791-A CLT", LAW, REFORM, ((f"{_RATE} < 5", f"{_RATE_SQL} < 5", "AVISO", "abaixo de 5%"), (f"{_RATE} > 15", f"{_RATE_SQL} > 15", "AVISO", "acima de 15%"))),
    ("CONSISTENCIA_DATAS", "Ordem das datas", "Consistência", CONSISTENCY, None, (
        ("hired_on > left_on", "hired_on > left_on", "ERRO", "admissão depois da demissão"), ("left_on > filed_on", "left_on > filed_on", "AVISO", "demissão depois do ajuizamento"),
        ("filed_on > ruled_on", "filed_on > ruled_on", "ERRO", "ajuizamento depois da sentença"), ("hired_on > filed_on", "hired_on > filed_on", "AVISO", "admissão depois do ajuizamento"))),
)

_ANY_REST = "(contains(lower(i.name), 'dsr') or contains(lower(i.name), 'descanso semanal'))"
_NAMED = " or ".join(f"contains(lower(r), '{x}')" for x in STRICT_NOT_OF_REST)
STRICT_ITEM_OUTCOMES = {
    "SUMULA_264_TST": (
        (_when(r"i.name rlike r'(?iu)horas?\s*extras?' and i.integrates is distinct from false and not exists(i.reflex, r -> r rlike r'(?iu)dsr|descanso\s*semanal')", "i.name || ' sem DSR'"), "AVISO"),
    ),
    "OJ_394_SDI1_TST": ((f"if({_ANY_REST}, transform(filter(i.reflex, r -> {_NAMED}), r -> 'DSR não reflete em ' || lower(r)), cast(array() as array<string>))", "ERRO"),),
}


def _rules(catalog, item_outcomes) -> tuple[Rule, ...]:
    return tuple(
        Rule(i, t, b, p, tuple((c, level, message(m)) for c, _, level, m in outs), since, every=i in EVERY, item_outcomes=item_outcomes.get(i, ()), case_values=_CASE_VALUES, item_values=_ITEM_VALUES) for i, t, b, p, since, outs in catalog
    )


RULES = _rules(CATALOG, ITEM_OUTCOMES)
STRICT_RULES = _rules(STRICT_CATALOG, STRICT_ITEM_OUTCOMES)
