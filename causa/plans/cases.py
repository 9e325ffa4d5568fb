"""Queries on items, rules and comparisons of cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import text
from causa.operators import compare, items, rules
from causa.plans import legal_rules
from causa.plans.normalise import CANON, CANON_KEY, q, sql_first, sql_norm
from causa.plans.registry import query
from causa.sources import files
from causa.sources.tables import derived, table

# items


@query("SELECT case_id, item_no, trim(name) AS name, coalesce(nullif(status, ''), 'deferida') AS status, nullif(period, '') AS period, len(list_filter(string_split(replace(reflexes, ' e ', ', '), ', '), lambda x: x <> '')) AS n_reflexes FROM items", "items")
def clean_items(spark, sf_dir):
    return items.clean(derived(spark, sf_dir, "items")).select("case_id", "item_no", "name", "status", "period", F.size("reflexes").cast("long").alias("n_reflexes"))


_FIRST = f"SELECT *, row_number() OVER (PARTITION BY case_id, canonical, period ORDER BY item_no) AS rn FROM (SELECT case_id, item_no, name, lower(trim(period)) AS period, {CANON_KEY} AS canonical FROM items)"


@query(f"SELECT case_id, item_no, canonical, period FROM ({_FIRST}) WHERE rn = 1", "items")
def item_dedup(spark, sf_dir):
    return items.ranked(derived(spark, sf_dir, "items")).where("rn = 1").select("case_id", "item_no", "canonical", "period")


@query(f"SELECT case_id, item_no, 'Verba repetida: ' || name || ' (' || period || ')' AS warning FROM ({_FIRST}) WHERE rn > 1", "items")
def item_dedup_warnings(spark, sf_dir):
    return items.ranked(derived(spark, sf_dir, "items")).where("rn > 1").select("case_id", "item_no", F.format_string("Verba repetida: %s (%s)", "name", "period").alias("warning"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS alerts FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) GROUP BY user_id""")
def merge_alerts(spark, sf_dir):
    """Distinct alerts of several lists, in the order in which they were first seen."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("alerts"))


_CLAUSES = r"""SELECT case_id, generate_subscripts(parts, 1) AS pos, trim(unnest(parts)) AS clause FROM (SELECT case_id, list_filter(string_split(regexp_replace(text, '([a-zà-ú])\. |; |\n', '\1~', 'g'), '~'), lambda x: trim(x) <> '') AS parts FROM texts)"""


def _parts():
    return F.filter(F.split(F.regexp_replace("text", r"([a-zà-ú])\. |; |\n", "$1~"), "~"), lambda x: F.trim(x) != "")


def clauses_of(spark, sf_dir):
    return _cut(derived(spark, sf_dir, "texts"))


def _cut(texts):
    return texts.select("case_id", F.posexplode(_parts()).alias("pos", "clause")).select("case_id", (F.col("pos") + 1).cast("long").alias("pos"), F.trim("clause").alias("clause"))


_GRANTED, _DENIED = catalogs.GRANTED, catalogs.DENIED
_STATUS = f"case when regexp_matches(clause, '{_GRANTED}') and regexp_matches(clause, '{_DENIED}') then 'partial' when regexp_matches(clause, '{_DENIED}') then 'denied' when regexp_matches(clause, '{_GRANTED}') then 'granted' end"
_PHRASE = sql_first("clause", tuple(sorted(((p.replace("+", "\\+").replace(".", "\\."), p) for p, _ in catalogs.PHRASES if len(p) > 3), key=lambda e: -len(e[1]))), "NULL")


def status_of(c):
    granted, denied = c.rlike(_GRANTED), c.rlike(_DENIED.replace("(?i)", "(?iu)"))
    return F.when(granted & denied, "partial").when(denied, "denied").when(granted, "granted")


@query(_CLAUSES, "texts")
def clauses(spark, sf_dir):
    return clauses_of(spark, sf_dir)


@query(f"SELECT case_id, pos, {_STATUS} AS status FROM ({_CLAUSES})", "texts")
def clause_status(spark, sf_dir):
    return clauses_of(spark, sf_dir).select("case_id", "pos", status_of(F.col("clause")).alias("status"))


@query(f"SELECT case_id, pos, {_PHRASE} AS item FROM ({_CLAUSES})", "texts")
def clause_item(spark, sf_dir):
    return clauses_of(spark, sf_dir).select("case_id", "pos", items.longest_phrase(F.col("clause"), [p for p, _ in catalogs.PHRASES if len(p) > 3]).alias("item"))


@query(f"SELECT * FROM (SELECT case_id, pos, {_PHRASE} AS item, {_STATUS} AS status FROM ({_CLAUSES})) WHERE item IS NOT NULL AND status IS NOT NULL", "texts")
def clause_items(spark, sf_dir):
    return clause_items_of(derived(spark, sf_dir, "texts"))


def clause_items_of(texts):
    rows = _cut(texts).select("case_id", "pos", items.longest_phrase(F.col("clause"), [p for p, _ in catalogs.PHRASES if len(p) > 3]).alias("item"), status_of(F.col("clause")).alias("status"))
    return rows.where("item is not null and status is not null")


@query("SELECT case_id, item_no, list_aggregate(list_sort(list_filter(string_split(lower(replace(reflexes, ' e ', ', ')), ', '), lambda x: x <> '')), 'string_agg', '|') AS reflexes FROM items", "items")
def reflex_list(spark, sf_dir):
    phrase = F.when(F.col("reflexes") != "", F.concat(F.lit("com reflexos em "), F.col("reflexes"), F.lit(". Fim")))
    return derived(spark, sf_dir, "items").select("case_id", "item_no", F.nullif(F.array_join(F.array_sort(items.reflexes(phrase)), "|"), F.lit("")).alias("reflexes"))


@query("SELECT case_id, item_no, case when name = 'hora extra 50%' then 50.0 when name = 'FGTS + multa de 40%' then 40.0 end AS surcharge FROM items", "items")
def near_percent(spark, sf_dir):
    t = F.lower("name")
    return derived(spark, sf_dir, "items").select("case_id", "item_no", F.coalesce(items.percent_near(t, "hora extra"), items.percent_near(t, "fgts")).alias("surcharge"))


@query("SELECT case_id, hired_on AS first_on, filed_on AS last_on FROM cases", "cases")
def text_period(spark, sf_dir):
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1)), lambda d: F.try_to_date(d, "dd/MM/yyyy")), lambda d: d.isNotNull())
    return derived(spark, sf_dir, "texts").select("case_id", F.try_element_at(found, F.lit(1)).alias("first_on"), F.try_element_at(found, F.lit(-1)).alias("last_on"))


_BASES = (("salário hora", "salario_hora"), ("valor hora", "salario_hora"), ("salário base", "salario_base"), ("salário contratual", "salario_base"), ("última remuneração", "ultima_remuneracao"), ("remuneração", "ultima_remuneracao"), ("salário mínimo", "salario_minimo"))


@query("SELECT case_id, case " + " ".join(f"when contains(lower(text), {q(a)}) then {q(b)}" for a, b in _BASES) + " end AS base FROM texts", "texts")
def base_key(spark, sf_dir):
    return derived(spark, sf_dir, "texts").select("case_id", F.transform(F.array(F.lower("text")), lambda t: F.coalesce(*(F.when(t.contains(a), b) for a, b in _BASES)))[0].alias("base"))


_SEGMENT_END = "(?i)([a-záéíóúãõ])\\.\\s"
_BY_LENGTH = tuple(sorted(((p.replace("º", "°"), k) for p, k in catalogs.PHRASES), key=lambda e: -len(e[0])))
_SEGMENTS = f"""SELECT *, replace(regexp_replace(lower(clause), '\\s+', ' ', 'g'), 'º', '°') AS low FROM (SELECT case_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS clause FROM (
  SELECT case_id, list_filter(list_transform(string_split(replace(regexp_replace(text, {q(_SEGMENT_END)}, '\\1' || chr(10), 'g'), ';', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM texts WHERE case_id NOT IN (SELECT case_id FROM items)))""".replace("\\\\", "\\")
_NAMED = "case " + " ".join(f"when regexp_matches(low, {q(rf'\b{p}\b')}) then {q(k)}" if len(p) <= 3 else f"when contains(low, {q(p)}) then {q(k)}" for p, k in _BY_LENGTH) + " end"


@query(f"""WITH found AS (SELECT case_id, pos, item FROM (SELECT case_id, pos, {_NAMED} AS item, {_STATUS} AS status FROM ({_SEGMENTS})) WHERE item IS NOT NULL AND status IN ('granted', 'partial')),
  named AS (SELECT case_id, name, min(n) AS n FROM texts JOIN (VALUES {', '.join(f"({i}, {q(a)}, {q(n)})" for i, (a, n) in enumerate(catalogs.NAMED_IN_TEXT))}) a(n, alias, name) ON contains(lower(text), alias)
    WHERE case_id NOT IN (SELECT case_id FROM items) AND case_id NOT IN (SELECT case_id FROM found) GROUP BY case_id, name)
  SELECT case_id, item_no AS pos, trim(name) AS item, 'list' AS origin FROM items UNION ALL SELECT case_id, pos, item, 'text' AS origin FROM found
  UNION ALL SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY n) AS pos, name AS item, 'alias' AS origin FROM named""", "texts items")
def item_backfill(spark, sf_dir):
    """Items from the text for the cases whose list is empty."""
    listed = derived(spark, sf_dir, "items")
    given = listed.select("case_id", F.col("item_no").cast("long").alias("pos"), F.trim("name").alias("item"), F.lit("list").alias("origin"))
    # the cases are written first, by their numbers alone, so that no other text is cut or compared
    without = files.kept(derived(spark, sf_dir, "cases").select("case_id").hint("merge").join(listed.select("case_id").distinct(), "case_id", "left_anti"), "without")
    texts = derived(spark, sf_dir, "texts").select("case_id", "text").join(F.broadcast(without) if without.count() <= items.FEW else without.hint("merge"), "case_id", "left_semi")
    return given.unionByName(items_in(texts))


def items_in(texts):
    """(case_id, pos, item, origin): keys of the items that clauses of a text grant, in whole or in part; where none does, the official names that the text holds."""

    def granted(clause, i):
        low = F.replace(F.regexp_replace(F.lower(clause), r"\s+", " "), F.lit("º"), F.lit("°"))
        # short phrases stand for themselves only, not inside of other words
        key = F.transform(F.array(low), lambda c: F.coalesce(*(F.when(c.rlike(rf"\b{p}\b") if len(p) <= 3 else c.contains(p), k) for p, k in _BY_LENGTH)))[0]
        item = F.when(status_of(clause).isin("granted", "partial"), key)
        return F.when(item.isNotNull(), F.struct((i + 1).cast("long").alias("pos"), item.alias("item"), F.lit("text").alias("origin")))

    cut = F.split(F.regexp_replace("text", _SEGMENT_END.replace("(?i)", "(?iu)"), "$1\n"), "[;\n]")
    clauses = F.filter(F.transform(cut, F.trim), lambda c: c != "")
    names = F.array_distinct(F.array_compact(F.transform(F.array(F.lower("text")), lambda t: F.array(*(F.when(t.contains(a), n) for a, n in catalogs.NAMED_IN_TEXT)))[0]))
    named = F.transform(names, lambda n, i: F.struct((i + 1).cast("long").alias("pos"), n.alias("item"), F.lit("alias").alias("origin")))
    read = texts.select("case_id", "text", F.array_compact(F.transform(clauses, granted)).alias("found"))
    return read.select("case_id", F.when(F.size("found") > 0, F.col("found")).otherwise(named).alias("found")).select("case_id", F.explode_outer("found").alias("f")).where("f is not null").select("case_id", "f.*")


_FAMILY = f"case when canonical in ('Horas Extras', 'Adicional Noturno', 'DSR') then 'jornada' when canonical in ('Férias', '13º Salário', 'Aviso Prévio', 'Saldo de Salário') then 'rescisão' when canonical like 'Dano%' then 'dano' when canonical like 'Multa%' then 'multa' end"


@query(f"SELECT case_id, item_no, canonical, {_FAMILY} AS family, canonical in ('DSR', 'FGTS') AS derived FROM (SELECT case_id, item_no, {CANON} AS canonical FROM items)", "items")
def item_family(spark, sf_dir):
    return items.with_family(derived(spark, sf_dir, "items")).select("case_id", "item_no", "canonical", "family", "derived")


@query(f"""WITH f AS (SELECT *, coalesce({_FAMILY}, cast(item_no as string)) AS grp FROM (SELECT case_id, item_no, reflexes, {CANON} AS canonical FROM items)),
  r AS (SELECT case_id, grp, string_agg(DISTINCT x, '|' ORDER BY x) AS reflexes FROM (SELECT case_id, grp, unnest(string_split(lower(replace(reflexes, ' e ', ', ')), ', ')) AS x FROM f) WHERE x <> '' GROUP BY ALL)
  SELECT f.case_id, f.grp, min(item_no) AS first_item, count(*) AS n_items, coalesce(any_value(r.reflexes), '') AS reflexes FROM f LEFT JOIN r ON f.case_id = r.case_id AND f.grp = r.grp GROUP BY f.case_id, f.grp""", "items")
def item_rollup(spark, sf_dir):
    rows = items.with_family(derived(spark, sf_dir, "items")).withColumn("grp", F.coalesce("family", F.col("item_no").cast("string")))
    parts = F.filter(F.split(F.lower(F.replace("reflexes", F.lit(" e "), F.lit(", "))), ", "), lambda x: x != "")
    return rows.groupBy("case_id", "grp").agg(F.min("item_no").alias("first_item"), F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(parts)))), "|").alias("reflexes"))


@query(f"""SELECT case_id, chr(96 + cast(row_number() OVER (PARTITION BY case_id ORDER BY canonical, item_no) as int)) || ') ' || canonical || case when canonical <> 'FGTS' and max(case when canonical = 'FGTS' then 1 else 0 end) OVER (PARTITION BY case_id) = 1 then ', com FGTS' else '' end AS line
  FROM (SELECT case_id, item_no, {CANON} AS canonical FROM items WHERE status = 'deferida')""", "items")
def opinion_lines(spark, sf_dir):
    rows = derived(spark, sf_dir, "items").where("status = 'deferida'").select("case_id", "item_no", text.canonical_name(F.col("name")).alias("canonical"))
    by_case = Window.partitionBy("case_id")
    letter = F.char(96 + F.row_number().over(by_case.orderBy("canonical", "item_no")))
    fund = F.max((F.col("canonical") == "FGTS").cast("int")).over(by_case) == 1
    return rows.select("case_id", F.concat(letter, F.lit(") "), F.col("canonical"), F.when(fund & (F.col("canonical") != "FGTS"), ", com FGTS").otherwise("")).alias("line"))


@query("SELECT case_id, count(*) FILTER (WHERE coalesce(nullif(status, ''), 'deferida') = 'deferida') AS granted, count(*) FILTER (WHERE status = 'indeferida') AS denied FROM items GROUP BY case_id", "items")
def item_counts(spark, sf_dir):
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("deferida"))
    return derived(spark, sf_dir, "items").groupBy("case_id").agg(F.count_if(status == "deferida").alias("granted"), F.count_if(status == "indeferida").alias("denied"))


# rules


def full_cases(spark, sf_dir):
    """Cases with their items nested in order; one shuffle by case. Names and reflexes repeat, so they are read once per different text."""
    reflex = F.transform(F.filter(F.split("reflexes", ", | e "), lambda x: x != ""), text.canonical_name)
    rows = items.with_values(derived(spark, sf_dir, "items"), "name", canonical=text.canonical_name(F.col("name")), canonical_key=text.canonical_key(F.col("name")))
    rows = items.with_values(rows, "reflexes", reflex=reflex)
    item = F.struct("item_no", "name", "status", "period", "reflex", "integrates", "amount", "canonical", "canonical_key")
    each = rows.select("case_id", item.alias("item"))  # projected first: what an aggregate collects isn't compiled
    nested = each.groupBy("case_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = derived(spark, sf_dir, "cases").withColumn("number_ok", text.check_digit_ok(F.col("number"))).join(nested, "case_id", "left")
    return rows.withColumn("items", F.coalesce("items", F.array().cast(nested.schema["items"].dataType)))


def _flag(p: str) -> str:
    return f"coalesce(bool_or(regexp_matches(name, '(?i){p}')), false)"


_FACTS = f"""SELECT c.*, f.* EXCLUDE (case_id), coalesce(own_vacation, false) AS paid_vacation, coalesce(own_notice, false) AS paid_notice FROM cases c LEFT JOIN (SELECT case_id,
  {_flag('aviso\\s*pr[eé]vio')} AS has_notice, {_flag('467')} AS has_467, {_flag('477')} AS has_477, {_flag(legal_rules.BASE)} AS has_base, {_flag('dano\\s*moral')} AS has_damage,
  bool_or(lower(name) LIKE '%indenizada%' AND lower(name) LIKE '%férias%') AS own_vacation, bool_or(lower(name) LIKE '%indenizado%' AND lower(name) LIKE '%aviso%') AS own_notice, max(amount) FILTER (WHERE contains(name, '477')) AS fine FROM items GROUP BY case_id) f ON c.case_id = f.case_id"""

_REFLEX = sql_first("part", catalogs.CANONICAL_ITEMS, "trim(part)")
_values = lambda names: ", ".join(f"({n}, {q(x)})" for n, x in enumerate(names))
#: Items, reflexes as they stand (r0), are added (radd), are removed (rdel) and are left (r).
_ITEM_FACTS = f"""i AS (SELECT case_id, item_no, name, lower(status) AS status, lower(trim(period)) AS period, reflexes, integrates, amount, {CANON} AS canonical, {CANON_KEY} AS canonical_key FROM items),
r0 AS (SELECT DISTINCT case_id, item_no, {_REFLEX} AS reflex FROM (SELECT case_id, item_no, unnest(string_split(replace(reflexes, ' e ', ', '), ', ')) AS part FROM i) WHERE part <> ''),
radd AS (SELECT i.case_id, i.item_no, d.reflex, d.n FROM i CROSS JOIN (VALUES {_values(legal_rules.DUE)}) d(n, reflex) ANTI JOIN r0 ON r0.case_id = i.case_id AND r0.item_no = i.item_no AND r0.reflex = d.reflex WHERE lower(i.name) LIKE '%horas extras%'),
rdel AS (SELECT i.case_id, i.item_no, d.reflex, d.n FROM i JOIN r0 USING (case_id, item_no) JOIN (VALUES {_values(legal_rules.NOT_OF_REST)}) d(n, reflex) ON d.reflex = r0.reflex WHERE lower(i.name) LIKE '%dsr%' OR lower(i.name) LIKE '%repouso semanal%'),
r AS (SELECT case_id, item_no, reflex FROM (SELECT * FROM r0 UNION ALL SELECT case_id, item_no, reflex FROM radd) u ANTI JOIN rdel USING (case_id, item_no, reflex)),
twice AS (SELECT *, row_number() OVER (PARTITION BY case_id, canonical, period ORDER BY item_no) AS nth, row_number() OVER (PARTITION BY case_id, canonical_key, period ORDER BY item_no) AS nth_key FROM i)"""

_PAIRS = ", ".join(f"({q(n)}, {q(x)})" for n, xs in legal_rules.BARRED.items() for x in xs)
_BAND = "case when amount IS NULL OR reais IS NULL OR reais <= 0 then 'verificar faixa' when amount / reais <= 3 then 'leve' when amount / reais <= 5 then 'médio' when amount / reais <= 20 then 'grave' when amount / reais <= 50 then 'gravíssimo' else 'acima de gravíssimo' end"
#: Rule: SQL of (case_id, level, message) over the item facts.
_ITEM_SQL = {
    "SUMULA_264_TST": "SELECT case_id, 'INFO' AS level, any_value(name) || ' + ' || string_agg(reflex, ', ' ORDER BY n) AS message FROM radd JOIN i USING (case_id, item_no) GROUP BY case_id, item_no",
    "OJ_394_SDI1_TST": """SELECT case_id, 'AVISO' AS level, any_value(name) || ' - ' || string_agg(reflex, ', ' ORDER BY n) AS message FROM rdel JOIN i USING (case_id, item_no) GROUP BY case_id, item_no
      UNION ALL SELECT case_id, 'INFO', name || ' verificado' FROM i ANTI JOIN rdel USING (case_id, item_no) WHERE lower(name) LIKE '%dsr%' OR lower(name) LIKE '%repouso semanal%'""",
    "OJ_394_SDI1_TST_REFLEXOS_PROIBIDOS": f"SELECT case_id, 'ERRO' AS level, i.canonical || ' não reflete em ' || r.reflex AS message FROM i JOIN r USING (case_id, item_no) JOIN (VALUES {_PAIRS}) p(item, reflex) ON p.item = i.canonical AND p.reflex = r.reflex",
    "ART_223G_DANO_EXTRAPATRIMONIAL": f"SELECT case_id, case when band LIKE 'acima%' then 'AVISO' else 'INFO' end AS level, name || ': ' || band AS message FROM (SELECT i.case_id, name, {_BAND} AS band FROM i JOIN cases USING (case_id) WHERE regexp_matches(name, '(?i){legal_rules.DAMAGE}') AND i.status IN ('deferida', 'deferido', ''))",
    "ART_58_ITINERE_REFORMA": f"SELECT case_id, 'ERRO' AS level, name || ' não é jornada' AS message FROM i WHERE coalesce(status, '') IN ('deferida', 'deferido', '') AND regexp_matches(name, '(?i){legal_rules.COMMUTE}')",
    "CONSISTENCIA_BIS_IN_IDEM_REFLEXOS": "SELECT case_id, 'ERRO' AS level, canonical || ' sobre si' AS message FROM i SEMI JOIN r ON r.case_id = i.case_id AND r.item_no = i.item_no AND r.reflex = i.canonical",
    "CONSISTENCIA_INTEGRACAO_SEM_REFLEXOS": "SELECT case_id, 'AVISO' AS level, canonical || ' sem reflexos' AS message FROM i ANTI JOIN r USING (case_id, item_no) WHERE integrates",
    "CONSISTENCIA_VERBAS_DUPLICADAS": "SELECT case_id, 'AVISO' AS level, name || ' repetida' AS message FROM twice WHERE nth > 1",
    "S9_VERBA_DEDUPLICATOR": "SELECT case_id, 'AVISO' AS level, name || ' repetida' AS message FROM twice WHERE nth_key > 1",
    "BIS_IN_IDEM_VERBAS": "SELECT case_id, 'ERRO' AS level, name || ' sobre si' AS message FROM i SEMI JOIN r ON r.case_id = i.case_id AND r.item_no = i.item_no AND lower(r.reflex) = lower(i.canonical)",
}


def _rule_sql(catalog=legal_rules.CATALOG, item_sql=_ITEM_SQL) -> str:
    parts = []
    for i, _, _, p, since, outs in catalog:
        valid = f"coalesce(hired_on >= date '{since}', true)" if since else "true"
        if i in item_sql:
            parts.append(f"SELECT x.case_id, {q(i)} AS rule_id, level, message, {p} AS priority FROM ({item_sql[i]}) x SEMI JOIN (SELECT case_id FROM cases WHERE {valid}) v ON v.case_id = x.case_id")
            continue
        before = "false"
        for _, s, level, m in outs:  # the first that holds, or all that do
            parts.append(f"SELECT case_id, {q(i)} AS rule_id, {q(level)} AS level, {legal_rules.message(m)} AS message, {p} AS priority FROM facts WHERE {valid} AND ({s}) AND NOT coalesce({before}, false)")
            before = before if i in legal_rules.EVERY else f"coalesce({before}, false) OR ({s})"
    return " UNION ALL ".join(parts)


def _alerts_sql(rest: str) -> str:
    return f"WITH facts AS ({_FACTS}), {_ITEM_FACTS}, alerts AS ({_rule_sql()}) {rest}"


_META = "(VALUES " + ", ".join(f"({q(r.id)}, {q(r.title)}, {q(r.basis)})" for r in legal_rules.RULES) + ") m(rule_id, title, basis)"


def alerts_of(spark, sf_dir):
    return rules.apply(full_cases(spark, sf_dir), legal_rules.RULES)


@query(_alerts_sql("SELECT * FROM alerts"), "cases items")
def rule_alerts(spark, sf_dir):
    return alerts_of(spark, sf_dir)


_STRICT_REST = "|".join(legal_rules.STRICT_NOT_OF_REST)
_STRICT_SQL = {
    "SUMULA_264_TST": r"""SELECT case_id, 'AVISO' AS level, name || ' sem DSR' AS message FROM i ANTI JOIN (SELECT * FROM r0 WHERE regexp_matches(lower(reflex), 'dsr|descanso\s*semanal')) d USING (case_id, item_no)
      WHERE regexp_matches(name, '(?i)horas?\s*extras?') AND integrates IS DISTINCT FROM false""",
    "OJ_394_SDI1_TST": f"""SELECT case_id, 'ERRO' AS level, 'DSR não reflete em ' || lower(reflex) AS message FROM i JOIN r0 USING (case_id, item_no)
      WHERE regexp_matches(lower(name), 'dsr|descanso semanal') AND regexp_matches(lower(reflex), '{_STRICT_REST}')""",
}


@query(f"WITH facts AS ({_FACTS}), {_ITEM_FACTS} {_rule_sql(legal_rules.STRICT_CATALOG, _STRICT_SQL)}", "cases items")
def rule_alerts_strict(spark, sf_dir):
    """Alerts of the strict variants, which are off unless asked for; no rule changes what another reads."""
    return rules.apply(full_cases(spark, sf_dir), legal_rules.STRICT_RULES)


_DATED = ", ".join(f"({q(r.id)}, date '{r.since or '1900-01-01'}')" for r in legal_rules.RULES)


@query(f"SELECT rule_id, count(*) AS cases FROM cases, (VALUES {_DATED}) r(rule_id, since) WHERE hired_on >= since GROUP BY rule_id", "cases")
def rule_applicable(spark, sf_dir):
    """Cases that each rule's validity covers; the catalog is as short as the rule list."""
    meta = rules.metadata(spark, legal_rules.RULES).select("rule_id", F.coalesce(F.col("since").cast("date"), F.lit("1900-01-01").cast("date")).alias("since"))
    per_day = derived(spark, sf_dir, "cases").groupBy("hired_on").agg(F.count(F.lit(1)).alias("n"))
    return per_day.join(F.broadcast(meta), F.col("hired_on") >= F.col("since")).groupBy("rule_id").agg(F.sum("n").alias("cases"))


@query(_alerts_sql(f"SELECT case_id, a.rule_id, title, basis, level FROM alerts a JOIN {_META} ON a.rule_id = m.rule_id"), "cases items")
def rule_memorial(spark, sf_dir):
    meta = rules.metadata(spark, legal_rules.RULES).select("rule_id", "title", "basis")
    return alerts_of(spark, sf_dir).join(F.broadcast(meta), "rule_id").select("case_id", "rule_id", "title", "basis", "level")


@query(_alerts_sql("SELECT status, level, count(*) AS alerts, count(DISTINCT a.case_id) AS cases FROM alerts a JOIN cases c ON a.case_id = c.case_id GROUP BY status, level"), "cases items")
def severity_counts(spark, sf_dir):
    """Alerts and cases by case status and level."""
    # counted per case first, which is where its alerts lie, so only counts are exchanged
    each = rules.apply(full_cases(spark, sf_dir), legal_rules.RULES, carry=["status"]).groupBy("case_id", "status", "level").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("status", "level").agg(F.sum("n").alias("alerts"), F.count(F.lit(1)).alias("cases"))


@query(_alerts_sql("SELECT rule_id, count(*) AS alerts FROM alerts WHERE priority <= 20 GROUP BY rule_id"), "cases items")
def rules_up_to(spark, sf_dir):
    chosen = [r for r in legal_rules.RULES if r.priority <= 20]
    return rules.apply(full_cases(spark, sf_dir), chosen).groupBy("rule_id").agg(F.count(F.lit(1)).alias("alerts"))


@query(f"""WITH f AS ({_FACTS}), {_ITEM_FACTS} SELECT case_id, coalesce(fund_on_notice, 'SIM') AS fund_on_notice, coalesce(fund_on_vacation, case when paid_vacation then 'NAO_INCIDE' else 'NAO_APLICAVEL' end) AS fund_on_vacation, coalesce(fine_on_notice, case when paid_notice then 'NAO_INCIDE' else 'INCIDE' end) AS fine_on_notice,
  coalesce(try_cast(nullif(regexp_extract(notice, '^([0-9]+)', 1), '') AS INT), cast(least(90, 30 + 3 * least(20, floor((left_on - hired_on) / 365))) as int)) AS notice_days,
  coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, case when hired_on >= date '2020-12-18' AND contains(rate_index, 'IPCA') AND contains(rate_index, 'SELIC') then 'IPCA-E' end AS index_before_filing,
  case when hired_on >= date '2020-12-18' AND contains(rate_index, 'SELIC') then 'SELIC' end AS index_from_filing, case when hired_on >= date '2020-12-18' AND contains(rate_index, 'SELIC') then 'sem_juros_separados' end AS interest_from_filing FROM f LEFT JOIN (SELECT case_id, count(*) AS n_added FROM radd GROUP BY case_id) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n_removed FROM rdel GROUP BY case_id) USING (case_id)""", "cases items")
def rule_effects(spark, sf_dir):
    """Values and reflexes that rules set, layer by layer of priority, before later rules read them."""
    from causa.functions import derive

    holds = lambda a, b: F.exists("items", lambda i: F.contains(F.lower(i["name"]), F.lit(a)) & F.contains(F.lower(i["name"]), F.lit(b)))
    ipca, selic = (F.contains(F.lower("rate_index"), F.lit(x)) for x in ("ipca", "selic"))
    in_force = F.coalesce(F.col("hired_on") >= F.lit("2020-12-18").cast("date"), F.lit(True))
    count = lambda e: F.expr(f"cast(aggregate(items, 0, (n, i) -> n + size({e})) as bigint)")
    return full_cases(spark, sf_dir).select(
        "case_id", F.coalesce("fund_on_notice", F.lit("SIM")).alias("fund_on_notice"),
        F.coalesce("fund_on_vacation", F.when(holds("indenizada", "férias"), "NAO_INCIDE").otherwise("NAO_APLICAVEL")).alias("fund_on_vacation"),
        F.coalesce("fine_on_notice", F.when(holds("indenizado", "aviso"), "NAO_INCIDE").otherwise("INCIDE")).alias("fine_on_notice"),
        F.coalesce(F.regexp_extract("notice", r"^([0-9]+)", 1).try_cast("int"), derive.notice_days(F.col("hired_on"), F.col("left_on"))).alias("notice_days"),
        count(legal_rules._ADDED).alias("n_added"), count(legal_rules._REMOVED).alias("n_removed"),
        *(F.when(in_force & c, v).alias(n) for n, v, c in (("index_before_filing", "IPCA-E", ipca & selic), ("index_from_filing", "SELIC", selic), ("interest_from_filing", "sem_juros_separados", selic))),
    )


@query(_alerts_sql(f"SELECT case_id, string_agg('[' || level || '] ' || title || ': ' || message, chr(10) ORDER BY priority, a.rule_id, '[' || level || '] ' || title || ': ' || message) AS explanation FROM alerts a JOIN {_META} ON a.rule_id = m.rule_id GROUP BY case_id"), "cases items")
def explanations(spark, sf_dir):
    meta = rules.metadata(spark, legal_rules.RULES).select("rule_id", "title")
    line = F.format_string("[%s] %s: %s", "level", "title", "message")
    rows = alerts_of(spark, sf_dir).join(F.broadcast(meta), "rule_id").select("case_id", F.struct("priority", "rule_id", line.alias("line")).alias("s"))
    return rows.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("explanation"))


_FROM_FIELDS = (("rate_index", "ADC_58_STF"), ("interest", "ART_39_LEI_8177"), ("fee", "ART_791A_CLT"), ("notice", "ART_487_CLT_LEI_12506"))


@query("SELECT rule_id, count(*) AS cases FROM (" + " UNION ALL ".join(f"SELECT case_id, {q(r)} AS rule_id FROM cases WHERE lower(trim({c})) NOT IN ({', '.join(map(q, catalogs.NULL_MARKERS))})" for c, r in _FROM_FIELDS) + ") GROUP BY rule_id", "cases")
def rules_from_fields(spark, sf_dir):
    rows = derived(spark, sf_dir, "cases").select("case_id", *(text.clean_null(F.col(c)).alias(c) for c, _ in _FROM_FIELDS))
    long = rows.unpivot("case_id", [c for c, _ in _FROM_FIELDS], "field", "value").where("value is not null")
    rule = F.coalesce(*(F.when(F.col("field") == c, r) for c, r in _FROM_FIELDS))
    return long.groupBy(rule.alias("rule_id")).agg(F.count(F.lit(1)).alias("cases"))


# learned rules

#: Learned rules: id, condition kind, argument, value that is expected, status. In production a table; here a short list.
LEARNED = (
    ("L1", "item_absent", "Horas Extras", "", "active"), ("L2", "item_present", "Dano Moral", "", "active"), ("L3", "index_absent", "", "", "shadow"), ("L4", "field_absent", "fee", "", "shadow"),
    ("L5", "item_present", "FGTS", "", "shadow"), ("L8", "item_absent", "Férias", "", "shadow"), ("L6", "field_differs", "reason", "Justa Causa", "shadow"), ("L7", "item_present", "Férias vencidas + 1/3 e reflexos", "", "active"),
)
_within = lambda a: f"(contains({sql_norm('name')}, {q(text._plain(a))}) OR contains({q(text._plain(a))}, {sql_norm('name')}))"
_LEARNED_SQL = f"""SELECT case_id, 'L1' AS rule_id, 'active' AS status FROM cases WHERE case_id NOT IN (SELECT case_id FROM items WHERE {_within('Horas Extras')}) UNION ALL
  SELECT DISTINCT case_id, 'L2', 'active' FROM items WHERE {_within('Dano Moral')} UNION ALL SELECT case_id, 'L3', 'shadow' FROM cases WHERE rate_index = 'n/a' UNION ALL
  SELECT case_id, 'L4', 'shadow' FROM cases WHERE fee = 'null' UNION ALL SELECT DISTINCT case_id, 'L5', 'shadow' FROM items WHERE {_within('FGTS')} UNION ALL
  SELECT case_id, 'L6', 'shadow' FROM cases WHERE reason IN ('rescisão indireta', 'pedido de demissão') UNION ALL SELECT case_id, 'L8', 'shadow' FROM cases WHERE case_id NOT IN (SELECT case_id FROM items WHERE {_within('Férias')}) UNION ALL SELECT DISTINCT case_id, 'L7', 'active' FROM items WHERE {_within('Férias vencidas + 1/3 e reflexos')}"""


def learned_hits(spark, sf_dir):
    """Hits of all learned rules, active and shadow, in one pass over the cases. Items and values match by containment of normalised names."""
    rows = full_cases(spark, sf_dir)
    rows = rows.withColumn("names", F.transform("items", lambda i: text.norm_text(i["name"])))
    has = lambda name: F.exists("names", lambda n: F.contains(n, F.lit(text._plain(name))) | F.contains(F.lit(text._plain(name)), n))
    given = lambda c: text.clean_null(F.col(c))
    test = {
        "item_absent": lambda a, v: ~has(a), "item_present": lambda a, v: has(a), "index_absent": lambda a, v: given("rate_index").isNull(), "field_absent": lambda a, v: given(a).isNull(),
        "field_differs": lambda a, v: ~F.contains(text.norm_text(given(a)), F.lit(text._plain(v))),
    }
    hits = F.array_compact(F.array(*(F.when(test[kind](arg, value), F.struct(F.lit(i).alias("rule_id"), F.lit(status).alias("status"))) for i, kind, arg, value, status in LEARNED)))
    return rows.select("case_id", F.explode(hits).alias("h")).select("case_id", "h.*")


@query(f"SELECT * FROM ({_LEARNED_SQL}) WHERE status = 'active'", "cases items")
def learned_rules(spark, sf_dir):
    return learned_hits(spark, sf_dir).where("status = 'active'")


@query(f"SELECT rule_id, count(*) AS hits FROM ({_LEARNED_SQL}) WHERE status = 'shadow' GROUP BY rule_id", "cases items")
def shadow_hits(spark, sf_dir):
    return learned_hits(spark, sf_dir).where("status = 'shadow'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


# comparisons

_MISSING = f"""SELECT i.case_id, i.item_no, i.name FROM (SELECT case_id, item_no, name, {CANON} AS canonical, lower(trim(name)) AS low FROM items WHERE coalesce(nullif(status, ''), 'deferida') <> 'indeferida') i
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT case_id, {CANON} AS canonical, lower(trim(name)) AS low FROM calc) c WHERE c.case_id = i.case_id AND (c.canonical = i.canonical OR contains(c.low, i.low) OR contains(i.low, c.low)))"""


def missing_of(spark, sf_dir):
    granted = derived(spark, sf_dir, "items").where("coalesce(nullif(status, ''), 'deferida') <> 'indeferida'")
    return compare.missing_items(granted, derived(spark, sf_dir, "calc"))


@query(_MISSING, "items calc")
def missing_items(spark, sf_dir):
    return missing_of(spark, sf_dir).select("case_id", "item_no", "name")


@query()
def missing_items_fuzzy(spark, sf_dir):
    """Missing items that no calculated item of the case resembles either."""
    return compare.drop_similar(missing_of(spark, sf_dir), derived(spark, sf_dir, "calc"))


_CALC_INDEX = "case cust_id % 4 when 0 then 'IPCA_E' when 1 then 'selic' when 2 then 'TR' end"


def calc_side(spark, sf_dir):
    c = F.col("cust_id") % 4
    return derived(spark, sf_dir, "cases").select("case_id", F.when(c == 0, "IPCA_E").when(c == 1, "selic").when(c == 2, "TR").alias("calc_index"), F.when(c == 3, "juros legais").otherwise("juros de 1% ao mês").alias("calc_interest"), F.when(c < 2, 220.0).otherwise(200.0).alias("calc_divisor"))


_BARE = "replace(replace(lower({}), '-', ''), '_', '')"
_INDEX_DIFF = f"SELECT case_id, rate_index, calc_index FROM (SELECT case_id, rate_index, {_CALC_INDEX} AS calc_index FROM cases) WHERE rate_index <> 'n/a' AND calc_index IS NOT NULL AND NOT contains({_BARE.format('rate_index')}, {_BARE.format('calc_index')}) AND NOT contains({_BARE.format('calc_index')}, {_BARE.format('rate_index')})"


def mismatches(spark, sf_dir, said, calculated):
    both = derived(spark, sf_dir, "cases").select("case_id", text.clean_null(F.col(said)).alias(said)).join(calc_side(spark, sf_dir), "case_id")
    return both.where(compare.differs(F.col(said), F.col(calculated))).select("case_id", said, calculated)


@query(_INDEX_DIFF, "cases")
def index_mismatch(spark, sf_dir):
    return mismatches(spark, sf_dir, "rate_index", "calc_index")


_INTEREST_DIFF = "SELECT case_id, interest, calc_interest FROM (SELECT case_id, interest, case when cust_id % 4 = 3 then 'juros legais' else 'juros de 1% ao mês' end AS calc_interest FROM cases) WHERE interest <> '-' AND interest <> calc_interest"


@query(_INTEREST_DIFF, "cases")
def interest_mismatch(spark, sf_dir):
    return mismatches(spark, sf_dir, "interest", "calc_interest")


def _first_named(missing, texts):
    """(case_id, item_no, fix): the first of the case's lines (pos, low, line) that holds the item's name, else a line that asks for it."""
    names = missing.groupBy("case_id").agg(F.collect_list(F.struct("item_no", "name", F.lower(F.trim("name")).alias("low"))).alias("names"))
    first = lambda n: F.array_min(F.transform(F.filter("lines", lambda c: F.contains(c["low"], n["low"])), lambda c: F.struct(c["pos"].alias("pos"), c["line"].alias("line"))))
    found = F.transform("names", lambda n: F.struct(n["item_no"].alias("item_no"), n["name"].alias("name"), first(n).alias("first")))
    each = names.hint("merge").join(texts, "case_id", "left").select("case_id", F.explode_outer(found).alias("f")).select("case_id", "f.*")
    best = each.groupBy("case_id", "item_no", "name").agg(F.min("first").alias("first"))
    return best.select("case_id", "item_no", F.coalesce("first.line", F.concat(F.lit("Incluir "), F.col("name"))).alias("fix"))


@query(f"""WITH m AS ({_MISSING}) SELECT m.case_id, m.item_no, coalesce(arg_min(substr(clause, 1, 200), pos), 'Incluir ' || any_value(m.name)) AS fix FROM m LEFT JOIN ({_CLAUSES}) c ON c.case_id = m.case_id AND length(clause) > 20 AND contains(lower(clause), lower(trim(m.name))) GROUP BY m.case_id, m.item_no""", "items calc texts")
def fix_excerpt(spark, sf_dir):
    """First clause of the ruling that names a missing item. A case's clauses and missing items meet in one row each; what
    texts hold compresses so well that the side that is broadcast can't be told by its bytes, so none is."""
    clause = F.transform(_parts(), lambda c, i: F.struct((i + 1).cast("long").alias("pos"), F.trim(c).alias("clause")))
    long = F.transform(F.filter(clause, lambda c: F.length(c["clause"]) > 20), lambda c: F.struct(c["pos"].alias("pos"), F.lower(c["clause"]).alias("low"), F.substring(c["clause"], 1, 200).alias("line")))
    return _first_named(missing_of(spark, sf_dir), derived(spark, sf_dir, "texts").select("case_id", long.alias("lines")))


@query("SELECT case_id, 'Súmula n° 264 do TST; OJ n° 394; art. 477 da CLT' AS basis FROM cases", "cases")
def item_basis(spark, sf_dir):
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p.replace("(?i)", "(?iu)", 1)), F.lit(0)) for p in catalogs.CITATIONS))
    return derived(spark, sf_dir, "texts").select("case_id", F.array_join(F.slice(F.array_distinct(found), 1, 3), "; ").alias("basis"))


@query(f"WITH m AS ({_MISSING}), n AS (SELECT DISTINCT case_id, {CANON} AS canonical FROM items WHERE item_no % 2 = 0) SELECT case_id, item_no, name FROM (SELECT *, {CANON} AS canonical FROM m) WHERE (case_id, canonical) NOT IN (SELECT case_id, canonical FROM n)", "items calc")
def guard_missing(spark, sf_dir):
    """Missing items that a second list of names knows after all are dropped."""
    return guarded(spark, sf_dir, missing_of(spark, sf_dir))


def guarded(spark, sf_dir, missing):
    known = derived(spark, sf_dir, "items").where("item_no % 2 = 0").select("case_id", text.canonical_name(F.col("name")).alias("canonical")).distinct()
    return missing.join(known, ["case_id", "canonical"], "left_anti").select("case_id", "item_no", "name")


_AUDIT = f"""SELECT case_id, 'index' AS kind FROM ({_INDEX_DIFF}) UNION ALL SELECT case_id, 'interest' FROM ({_INTEREST_DIFF}) UNION ALL
  SELECT case_id, 'divisor' FROM (SELECT case_id, case when hours like '44%' then 220 when hours like '36%' then 180 when hours <> '-' then 200 end AS d, case when cust_id % 4 < 2 then 220 else 200 end AS c FROM cases) WHERE abs(d - c) > 0.01 UNION ALL SELECT DISTINCT case_id, 'items' FROM ({_MISSING})"""


def audit_of(spark, sf_dir):
    from causa.functions import derive

    divisor = derived(spark, sf_dir, "cases").select("case_id", derive.divisor(F.col("hours")).alias("d")).join(calc_side(spark, sf_dir), "case_id").where("abs(d - calc_divisor) > 0.01")
    kinds = (("index", index_mismatch(spark, sf_dir)), ("interest", interest_mismatch(spark, sf_dir)), ("divisor", divisor), ("items", missing_of(spark, sf_dir).select("case_id").distinct()))
    out = None
    for kind, rows in kinds:
        part = rows.select("case_id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_AUDIT, "cases items calc")
def calc_audit(spark, sf_dir):
    return audit_of(spark, sf_dir)


@query("SELECT case_id, case when case_id % 2 = 0 then 'OJ n° 394' else 'Lei n° 12.506.' end AS point FROM cases", "cases")
def conflict_points(spark, sf_dir):
    """Citations of the objection that the opinion doesn't have."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all("text", F.lit(p.replace("(?i)", "(?iu)", 1)), F.lit(0)) for p in catalogs.CITATIONS)))
    opinion = F.filter(found, lambda x: ~F.when(F.col("case_id") % 2 == 0, x.startswith("OJ")).otherwise(x.startswith("Lei")))
    return derived(spark, sf_dir, "texts").select("case_id", F.array_join(F.array_except(found, opinion), "; ").alias("point"))


@query(f"SELECT case_id, count(*) AS differences, string_agg(kind, ',' ORDER BY kind) AS kinds, bool_or(kind = 'items') AS has_error FROM ({_AUDIT}) GROUP BY case_id", "cases items calc")
def discrepancy_report(spark, sf_dir):
    return audit_of(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("differences"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.bool_or(F.col("kind") == "items").alias("has_error"))


@query(f"SELECT kind, count(*) AS cases, case kind when 'items' then 'rule' else 'playbook' end AS target FROM ({_AUDIT}) GROUP BY kind", "cases items calc")
def learnings(spark, sf_dir):
    return audit_of(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("cases")).withColumn("target", F.when(F.col("kind") == "items", "rule").otherwise("playbook"))


@query(f"SELECT canonical, count(*) AS cases FROM (SELECT DISTINCT case_id, {CANON} AS canonical FROM ({_MISSING})) WHERE canonical NOT IN ('Horas Extras', 'FGTS') GROUP BY canonical", "items calc")
def predictive_rules(spark, sf_dir):
    """Missing items as candidates, but for those that a rule of that title covers."""
    found = missing_of(spark, sf_dir).select("case_id", "canonical").distinct()
    covered = spark.createDataFrame([("Horas Extras",), ("FGTS",)], "canonical string")
    return found.join(F.broadcast(covered), "canonical", "left_anti").groupBy("canonical").agg(F.count(F.lit(1)).alias("cases"))


@query("""SELECT user_id, string_agg(event_type, '|' ORDER BY src, first_id) AS merged FROM (SELECT user_id, event_type, min(src) AS src, arg_min(event_id, src * 1000000000 + event_id) AS first_id FROM (SELECT user_id, event_type, event_id, case when event_id % 2 = 0 then 0 else 1 end AS src FROM events) GROUP BY ALL) GROUP BY user_id""")
def merge_sources(spark, sf_dir):
    """Two lists in order, entries distinct on their first 200 characters."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct((F.col("event_id") % 2).alias("src"), "event_id").alias("at"))
    first = rows.groupBy("user_id", F.substring("event_type", 1, 200).alias("key")).agg(F.min(F.struct("at", "event_type")).alias("e"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["event_type"]), "|").alias("merged"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0 AND length(text) > 200) c WHERE c.h = md5(d.text))")
def incremental_worklist(spark, sf_dir):
    """Inputs whose content has no cached result of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n"))
    cached = docs.where("doc_id % 3 = 0 and n > 200").select("h").distinct()
    return docs.join(cached, "h", "left_anti").select("doc_id")


@query("SELECT case_id, case when case_id % 3 = 0 then number when case_id % 3 = 1 then seq_of else number end AS voted FROM (SELECT case_id, number, substr(number, 1, 7) AS seq_of FROM cases)", "cases")
def vote_case_number(spark, sf_dir):
    """Majority of three candidates; ties go to the first, missing ones don't vote."""
    c = derived(spark, sf_dir, "cases")
    third = F.col("case_id") % 3
    seq = F.substring("number", 1, 7)
    candidates = F.array(F.when(third == 0, F.col("number")).when(third == 1, seq).otherwise(F.lit("n/a")), F.when(third == 1, seq).otherwise(F.col("number")), F.when(third == 2, seq).otherwise(F.col("number")))
    valid = F.filter(F.transform(candidates, lambda x: text.clean_null(x)), lambda x: x.isNotNull())
    return c.select("case_id", compare.majority(valid).alias("voted"))


@query(f"SELECT DISTINCT case_id, canonical FROM (SELECT case_id, status, {CANON} AS canonical FROM items) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT case_id, {CANON} AS canonical FROM items WHERE status = 'deferida') g WHERE g.case_id = r.case_id AND g.canonical = r.canonical)", "items")
def requested_not_granted(spark, sf_dir):
    rows = derived(spark, sf_dir, "items").select("case_id", "status", text.canonical_name(F.col("name")).alias("canonical"))
    # one pass: what no row of the case grants
    return rows.groupBy("case_id", "canonical").agg(F.bool_or(F.col("status") == "deferida").alias("granted")).where("not coalesce(granted, false)").select("case_id", "canonical")


@query("""SELECT c.case_id, i.case_id IS NOT NULL AS has_decision, k.case_id IS NOT NULL AS has_calc, i.first_item, case when i.case_id IS NULL and k.case_id IS NULL then 'faltam: decisão, cálculo' when i.case_id IS NULL then 'faltam: decisão' when k.case_id IS NULL then 'faltam: cálculo' else 'completo' end AS message
  FROM cases c LEFT JOIN (SELECT case_id, arg_min(name, item_no) AS first_item FROM items GROUP BY case_id) i USING (case_id) LEFT JOIN (SELECT DISTINCT case_id FROM calc) k USING (case_id)""", "cases items calc")
def presence_triad(spark, sf_dir):
    first = derived(spark, sf_dir, "items").groupBy("case_id").agg(F.min_by("name", "item_no").alias("first_item"))
    calc = derived(spark, sf_dir, "calc").select("case_id").distinct().withColumn("has_calc", F.lit(True))
    rows = derived(spark, sf_dir, "cases").select("case_id").join(first, "case_id", "left").join(calc, "case_id", "left")
    decision, calculated = F.col("first_item").isNotNull(), F.coalesce("has_calc", F.lit(False))
    absent = F.concat_ws(", ", F.when(~decision, "decisão"), F.when(~calculated, "cálculo"))
    return rows.select("case_id", decision.alias("has_decision"), calculated.alias("has_calc"), "first_item", F.when(absent == "", "completo").otherwise(F.concat(F.lit("faltam: "), absent)).alias("message"))


@query(f"SELECT case_id, string_agg(cast(case when kind = 'items' then 40 else 60 end as string) || ' ' || kind, chr(10) ORDER BY case when kind = 'items' then 40 else 60 end, kind) AS memorial FROM ({_AUDIT}) GROUP BY case_id", "cases items calc")
def discrepancy_memorial(spark, sf_dir):
    prio = F.when(F.col("kind") == "items", 40).otherwise(60)
    line = F.concat(prio.cast("string"), F.lit(" "), F.col("kind"))
    return audit_of(spark, sf_dir).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("memorial"))


@query("""SELECT c.case_id, case when c.status = 'F' then 'file' when i.case_id IS NOT NULL then 'slice' else 'none' end AS origin, case when c.status = 'F' then c.case_id when i.case_id IS NOT NULL then i.first_no end AS ref FROM cases c LEFT JOIN (SELECT case_id, min(item_no) AS first_no FROM items WHERE item_no > 1 GROUP BY case_id) i USING (case_id)""", "cases items")
def source_resolution(spark, sf_dir):
    """An explicit file, else a slice found in the full one, else nothing and why."""
    slices = derived(spark, sf_dir, "items").where("item_no > 1").groupBy("case_id").agg(F.min("item_no").cast("long").alias("first_no"))
    rows = derived(spark, sf_dir, "cases").join(slices, "case_id", "left")
    file = F.col("status") == "F"
    return rows.select("case_id", F.when(file, "file").when(F.col("first_no").isNotNull(), "slice").otherwise("none").alias("origin"), F.when(file, F.col("case_id")).otherwise(F.col("first_no")).alias("ref"))


@query("SELECT user_id, string_agg(arg, ' | ' ORDER BY src, event_id) AS digest FROM (SELECT user_id, event_id, event_id % 3 AS src, substr(event_type || ' ' || props, 1, 12) AS arg FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) <= 5) GROUP BY user_id")
def argument_digest(spark, sf_dir):
    """The first five arguments of each of three sources, capped, in order."""
    w = Window.partitionBy("user_id", "src").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("src"), F.substring(F.concat_ws(" ", "event_type", "props"), 1, 12).alias("arg")).withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "event_id", "arg"))), lambda x: x["arg"]), " | ").alias("digest"))
