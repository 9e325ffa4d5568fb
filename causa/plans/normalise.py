"""Queries on normalised and derived values."""

from __future__ import annotations

from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import derive, text
from causa.operators import phrases
from causa.plans.registry import query
from causa.sources.tables import derived, table


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), {q(catalogs.ACCENTS[0])}, {q(catalogs.ACCENTS[1])}), '\\s+', ' ', 'g'))"


def sql_first(c: str, catalog, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, {q('(?i)' + p)}) then {q(v)}" for p, v in catalog) + f" else {default} end"


def sql_phrase(c: str, catalog) -> str:
    t = sql_norm(c)
    plain = [(text._plain(p), k) for p, k in catalog]
    near = []
    for p, k in plain:
        inside = f"contains(' ' || {t} || ' ', {q(f' {p} ')})" if len(p) <= 3 else f"contains({t}, {q(p)})"
        near.append(f"when {inside} or (length({t}) > 3 and contains({q(p)}, {t})) then {q(k)}")
    return "case " + " ".join(f"when {t} = {q(p)} then {q(k)}" for p, k in plain) + " " + " ".join(near) + " end"


CANON = sql_first("name", catalogs.CANONICAL_ITEMS, "trim(name)")
CANON_KEY = sql_first("name", catalogs.CANONICAL_KEYS, "lower(trim(name))")
_NULLS = ", ".join(map(q, catalogs.NULL_MARKERS))


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5, length({sql_norm('text')}) AS norm_chars FROM documents")
def norm_text(spark, sf_dir):
    norm = text.norm_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("long").alias("norm_chars"))


def sql_null(c: str) -> str:
    return f"case when lower(trim({c})) not in ({_NULLS}) then trim({c}) end"


@query(f"SELECT case_id, {sql_null('rate_index')} AS rate_index, {sql_null('interest')} AS interest, {sql_null('notice')} AS notice, {sql_null('fee')} AS fee FROM cases", "cases")
def clean_nulls(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", *(text.clean_null(F.col(c)).alias(c) for c in ("rate_index", "interest", "notice", "fee")))


@query("SELECT case_id, case when lower(trim(free_justice)) in ('true', 'sim', '1', 'yes', 'deferido', 'deferida') then true when lower(trim(free_justice)) in ('false', 'não', 'nao', '0', 'no', 'indeferido', 'indeferida') then false end AS free_justice FROM cases", "cases")
def clean_bool(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", text.clean_bool(F.col("free_justice")).alias("free_justice"))


@query("""SELECT case_id, case when lower(trim(free_justice)) in ('sim', 'true') then 'Deferida' when lower(trim(free_justice)) in ('não', 'false') then 'Indeferida' else free_justice end AS free_justice,
  case when lower(trim(interest)) in ('-', '') then 'não informado' else interest end AS interest FROM cases""", "cases")
def coerce_fields(spark, sf_dir):
    flag = text.clean_bool(F.col("free_justice"))
    return derived(spark, sf_dir, "cases").select("case_id", F.when(flag, "Deferida").when(~flag, "Indeferida").otherwise(F.col("free_justice")).alias("free_justice"), F.coalesce(text.clean_null(F.col("interest")), F.lit("não informado")).alias("interest"))


@query("SELECT case_id, cast(reais as decimal(18,2)) AS amount, cast(reais as decimal(18,2)) AS marked, cast(-round(price, 2) as decimal(18,2)) AS signed, cast(reais as decimal(18,2)) AS digits FROM cases", "cases")
def parse_money(spark, sf_dir):
    """The first amount of a text, the first that is marked, a signed one and all digits of a phrase, against the numbers that they were made of."""
    rows = derived(spark, sf_dir, "cases").select("case_id", F.replace((-F.round("price", 2)).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("signed"))
    pay = F.regexp_extract("text", r"(R\$ \d[\d.]*(?:,\d{1,2})?) por", 1)
    found = derived(spark, sf_dir, "texts").select("case_id", text.parse_money(pay).alias("amount"), text.parse_money(F.col("text"), "marked").alias("marked"), text.parse_money(pay, "digits").alias("digits"))
    return found.join(rows, "case_id").select("case_id", "amount", "marked", text.parse_money(F.col("signed"), "signed").alias("signed"), "digits")


@query("SELECT case_id, 'R$ ' || translate(format('{:,.2f}', price), ',.', '.,') AS price_text FROM cases", "cases")
def format_money(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", text.format_money(F.col("price")).alias("price_text"))


@query(f"SELECT case_id, hired_on AS from_slash, left_on AS from_dash, filed_on AS from_iso, ruled_on AS from_short, case when case_id % 4 = 3 then date '2024-03-12' end AS from_words FROM cases", "cases")
def parse_dates(spark, sf_dir):
    d = text.parse_date
    words = F.regexp_extract("text", r"Porto Alegre, (\d{1,2} de [a-zç]+ de \d{4})", 1)
    rows = derived(spark, sf_dir, "cases").select("case_id", "hired_on", "left_on", "filed_on", "ruled_on")
    both = rows.join(derived(spark, sf_dir, "texts").select("case_id", words.alias("words")), "case_id")
    return both.select("case_id", d(text.dmy(F.col("hired_on"))).alias("from_slash"), d(F.date_format("left_on", "dd-MM-yyyy")).alias("from_dash"), d(F.col("filed_on").cast("string")).alias("from_iso"), d(F.date_format("ruled_on", "dd/MM/yy")).alias("from_short"), d(F.col("words")).alias("from_words"))


@query("SELECT case_id, number, substr(number, 1, 7) AS seq, substr(number, 12, 4) AS year, case_id % 7 <> 0 AS valid FROM cases", "cases")
def check_digit(spark, sf_dir):
    part = lambda n: F.regexp_extract("number", text.NUMBER, n)
    return derived(spark, sf_dir, "cases").select("case_id", "number", part(1).alias("seq"), part(3).alias("year"), text.check_digit_ok(F.col("number")).alias("valid"))


@query(f"SELECT case_id, item_no, {CANON} AS canonical, {CANON_KEY} AS canonical_key FROM items", "items")
def canonical_name(spark, sf_dir):
    return derived(spark, sf_dir, "items").select("case_id", "item_no", text.canonical_name(F.col("name")).alias("canonical"), text.canonical_key(F.col("name")).alias("canonical_key"))


@query(f"SELECT case_id, item_no, {sql_phrase('name', catalogs.PHRASES)} AS item_key FROM items", "items")
def phrase_key(spark, sf_dir):
    return derived(spark, sf_dir, "items").select("case_id", "item_no", text.phrase_key(F.col("name")).alias("item_key"))


@query(f"SELECT case_id, string_agg(coalesce({sql_phrase('name', catalogs.PHRASES)}, name), '|' ORDER BY item_no) AS item_keys FROM items GROUP BY case_id", "items")
def phrase_key_list(spark, sf_dir):
    rows = derived(spark, sf_dir, "items").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "name"))).alias("names"))
    return rows.select("case_id", F.array_join(F.transform("names", lambda x: F.coalesce(text.phrase_key(x["name"]), x["name"])), "|").alias("item_keys"))


_ITEM_FIRST = f"""SELECT doc_id, arg_min(item_id, cast(t <> p AS BIGINT) * 1000000000 + item_id) AS item_id FROM (SELECT doc_id, {sql_norm('text')} AS t FROM documents) d JOIN (SELECT item_id, {sql_norm('text')} AS p FROM benchmark) b
  ON t = p OR CASE WHEN length(p) < 4 THEN contains(' ' || t || ' ', ' ' || p || ' ') ELSE contains(t, p) END OR (length(t) >= 4 AND contains(p, t)) WHERE t <> '' AND p <> '' GROUP BY doc_id"""


@query(_ITEM_FIRST)
def catalog_key(spark, sf_dir):
    """First entry of a catalog table, here the benchmark's items, that a document holds whole or that holds the document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = phrases.keys(docs, items.select(F.col("item_id").alias("rank"), F.col("text").alias("phrase"), F.col("item_id").alias("key")), "text")
    return docs.select("doc_id", text.norm_text(F.col("text")).alias("plain")).join(found, "plain").select("doc_id", F.col("key").alias("item_id"))


@query("""SELECT item_key, count(*) AS uses, string_agg(DISTINCT name, '|' ORDER BY name) AS variants FROM (SELECT name, """ + sql_phrase("name", catalogs.PHRASES) + """ AS item_key FROM items) WHERE item_key IS NOT NULL GROUP BY item_key""", "items")
def key_variants(spark, sf_dir):
    names = derived(spark, sf_dir, "items").groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("item_key", text.phrase_key(F.col("name")))
    return names.where("item_key is not null").groupBy("item_key").agg(F.sum("n").alias("uses"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("variants"))


@query(f"SELECT case_id, item_no, coalesce({sql_phrase('name', catalogs.ALIASES)}, name) AS official FROM items", "items")
def alias_map(spark, sf_dir):
    return derived(spark, sf_dir, "items").select("case_id", "item_no", F.coalesce(text.phrase_key(F.col("name"), catalogs.ALIASES), F.col("name")).alias("official"))


@query(r"""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k, event_id % 5 <> 0 AS valid FROM (SELECT event_id, case when event_id % 5 <> 0 then props end AS props FROM events)""")
def json_repair(spark, sf_dir):
    """Fences around a JSON text go; what still isn't JSON is null."""
    fenced = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n{\"k\": "), F.col("props"))).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    bare = F.regexp_replace(F.regexp_replace(fenced, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    parsed = F.try_parse_json(bare)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(parsed, "$.k", "int"), F.lit(-1)).alias("k"), parsed.isNotNull().alias("valid"))


@query("SELECT case_id, item_no, case when item_no % 2 = 0 then (item_no || '/12') else period end AS period, case when item_no % 2 = 0 then NULL else cast(quantity as string) end AS quantity FROM items", "items")
def period_repair(spark, sf_dir):
    given = F.when(F.col("item_no") % 2 == 0, F.concat(F.col("item_no").cast("string"), F.lit("/12"))).otherwise(F.col("quantity").cast("string"))
    rows = derived(spark, sf_dir, "items").withColumn("given", given)
    misplaced = F.col("given").rlike(r"^\d+/12$")
    return rows.select("case_id", "item_no", F.when(misplaced, F.col("given")).otherwise(F.col("period")).alias("period"), F.when(~misplaced, F.col("given")).alias("quantity"))


@query("SELECT case_id, item_no, case when integrates then 'Sim' else 'Não' end AS integrates, replace(replace(reflexes, ', ', ' | '), ' e ', ' | ') AS reflexes FROM items", "items")
def readable(spark, sf_dir):
    parts = F.split("reflexes", r", | e ")
    return derived(spark, sf_dir, "items").select("case_id", "item_no", F.when(F.col("integrates"), "Sim").otherwise("Não").alias("integrates"), F.array_join(parts, " | ").alias("reflexes"))


@query(r"SELECT event_id, case when event_id % 2 = 0 then lpad(cast(event_id as string), 11, '0') else strftime(ts, '%d/%m/%Y') end AS plain FROM events")
def plain_format(spark, sf_dir):
    padded = F.lpad(F.col("event_id").cast("string"), 11, "0")
    dotted = F.concat(F.substring(padded, 1, 3), F.lit("."), F.substring(padded, 4, 3), F.lit("."), F.substring(padded, 7, 3), F.lit("-"), F.substring(padded, 10, 2))
    given = F.when(F.col("event_id") % 2 == 0, dotted).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", text.plain_format(given).alias("plain"))


@query("SELECT event_id, case event_type when 'error' then 'ERRO' when 'view' then 'INFO' else 'AVISO' end AS level, event_type AS message FROM events")
def alert_parse(spark, sf_dir):
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("[erro] "), F.col("event_type"))).when(F.col("event_type") == "view", F.concat(F.lit("[INFO] "), F.col("event_type"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.alert_level(given).alias("level"), text.alert_text(given).alias("message"))


@query("SELECT case_id, item_no, case when status = 'indeferida' then 'denied' when status = 'parcialmente deferida' then 'partial' when status = 'deferida' then 'granted' else 'unknown' end AS bucket FROM items", "items")
def status_bucket(spark, sf_dir):
    return derived(spark, sf_dir, "items").select("case_id", "item_no", text.status_bucket(F.col("status")).alias("bucket"))


@query("SELECT case_id, case when schedule like '%intervalo' then 9.0 when schedule like '%9h%' then 9.0 when schedule like '%22:00%' then 8.0 end AS hours_day, case when schedule like '%intervalo' then 54.0 when schedule like '%9h%' then 54.0 when schedule like '%22:00%' then 48.0 end AS hours_week FROM cases", "cases")
def derive_hours(spark, sf_dir):
    day = derive.hours_per_day(F.col("schedule"))
    return derived(spark, sf_dir, "cases").select("case_id", day.alias("hours_day"), (day * 6).alias("hours_week"))


@query("SELECT case_id, case when hours like '44%' then 220 when hours like '40%' then 200 when hours like '36%' then 180 when hours like 'div%' then 200 end AS divisor FROM cases", "cases")
def derive_divisor(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", derive.divisor(F.col("hours")).alias("divisor"))


@query("SELECT case_id, cast(filed_on - INTERVAL 60 MONTH AS date) AS limit_on FROM cases", "cases")
def derive_limitation(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", derive.limitation(F.col("filed_on")).alias("limit_on"))


@query(r"SELECT case_id, left_on + coalesce(try_cast(regexp_extract(notice, '(\d+)', 1) AS INT), 0) AS exit_on FROM cases", "cases")
def derive_exit(spark, sf_dir):
    days = F.coalesce(F.regexp_extract("notice", r"(\d+)", 1).try_cast("int"), F.lit(0))
    return derived(spark, sf_dir, "cases").select("case_id", F.date_add("left_on", days).alias("exit_on"))


@query("SELECT case_id, 'De ' || strftime(hired_on, '%d/%m/%Y') || ' a ' || strftime(left_on, '%d/%m/%Y') AS period_label, 'Salário fixo de R$ ' || reais || ',00' AS pay_label FROM cases", "cases")
def derive_labels(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", F.format_string("De %s a %s", text.dmy(F.col("hired_on")), text.dmy(F.col("left_on"))).alias("period_label"), F.concat(F.lit("Salário fixo de R$ "), F.col("reais").cast("string"), F.lit(",00")).alias("pay_label"))


_MONTHS = "(year(left_on) - year(hired_on)) * 12 + month(left_on) - month(hired_on) + case when day(left_on) >= 15 then 1 else 0 end"


@query(f"SELECT case_id, {_MONTHS} AS months, ({_MONTHS}) % 12 AS twelfths FROM cases", "cases")
def period_months(spark, sf_dir):
    months = derive.months_worked(F.col("hired_on"), F.col("left_on"))
    return derived(spark, sf_dir, "cases").select("case_id", months.alias("months"), (months % 12).alias("twelfths"))


@query("""SELECT case_id, week AS hours_week, week / 6.0 AS hours_day, greatest(coalesce(h, 8.0) - 8, 0) AS excess_day FROM (
  SELECT case_id, coalesce(try_cast(regexp_extract(hours, '^(\\d{2}) horas', 1) AS DOUBLE), 44.0) AS week, case when schedule like '%intervalo' or schedule like '%9h%' then 9.0 when schedule like '%22:00%' then 8.0 end AS h FROM cases)""".replace("\\\\", "\\"), "cases")
def hours_params(spark, sf_dir):
    week = F.coalesce(F.regexp_extract("hours", r"^(\d{2}) horas", 1).try_cast("double"), F.lit(44.0))
    return derived(spark, sf_dir, "cases").select("case_id", week.alias("hours_week"), (week / 6).alias("hours_day"), F.greatest(F.coalesce(derive.hours_per_day(F.col("schedule")), F.lit(8.0)) - 8, F.lit(0.0)).alias("excess_day"))


@query(f"""SELECT case_id, item_no, canonical, case canonical when 'Horas Extras' then 1.0 + percent / 100.0 when 'Adicional Noturno' then 0.2 else 1.0 end AS multiplier,
  case when canonical in ('Horas Extras', 'Adicional Noturno') then 'salario_hora' else 'ultima_remuneracao' end AS base, case when canonical = 'Horas Extras' then 'DSR|FGTS|Férias|13º Salário' else '' end AS reflexes
  FROM (SELECT *, {CANON} AS canonical FROM items WHERE status = 'deferida')""", "items")
def item_params(spark, sf_dir):
    c = F.col("canonical")
    rows = derived(spark, sf_dir, "items").where("status = 'deferida'").withColumn("canonical", text.canonical_name(F.col("name")))
    return rows.select(
        "case_id", "item_no", "canonical",
        F.when(c == "Horas Extras", 1.0 + F.col("percent") / 100.0).when(c == "Adicional Noturno", 0.2).otherwise(1.0).alias("multiplier"),
        F.when(c.isin("Horas Extras", "Adicional Noturno"), "salario_hora").otherwise("ultima_remuneracao").alias("base"),
        F.array_join(F.when(c == "Horas Extras", F.array(*map(F.lit, ("DSR", "FGTS", "Férias", "13º Salário")))).otherwise(F.array().cast("array<string>")), "|").alias("reflexes"),
    )


@query(r"""SELECT case_id, case when regexp_matches(rate_index, 'IPCA') and regexp_matches(rate_index, 'SELIC') then 'IPCA-E até a citação, SELIC depois' when rate_index like '%SELIC%' then 'SELIC' when rate_index like '%IPCA%' then 'IPCA-E' when rate_index = 'TR' then 'TR' else 'IPCA-E' end AS chosen_index,
  case when interest like '%1%' then '1% ao mês' when interest like '%SELIC%' then 'SELIC' else 'legais' end AS chosen_interest FROM cases""", "cases")
def index_params(spark, sf_dir):
    i, j = F.col("rate_index"), F.col("interest")
    ipca, selic = i.rlike(r"(?i)\bIPCA"), i.rlike(r"(?i)\bSELIC\b")
    index = F.when(ipca & selic, "IPCA-E até a citação, SELIC depois").when(selic, "SELIC").when(ipca, "IPCA-E").when(i.rlike(r"(?i)\bTR\b"), "TR").otherwise("IPCA-E")
    return derived(spark, sf_dir, "cases").select("case_id", index.alias("chosen_index"), F.when(j.contains("1%"), "1% ao mês").when(j.contains("SELIC"), "SELIC").otherwise("legais").alias("chosen_interest"))


@query(r"SELECT case_id, 8.0 AS fund_rate, case when reason in ('sem justa causa', 'rescisão indireta') then 40.0 else 0.0 end AS fund_fine, coalesce(try_cast(regexp_extract(fee, '(\d+)%', 1) AS DOUBLE), 0.0) AS fee_rate FROM cases", "cases")
def charge_params(spark, sf_dir):
    fee = F.coalesce(F.regexp_extract("fee", r"(\d+)%", 1).try_cast("double"), F.lit(0.0))
    return derived(spark, sf_dir, "cases").select("case_id", F.lit(8.0).alias("fund_rate"), F.when(F.col("reason").isin("sem justa causa", "rescisão indireta"), 40.0).otherwise(0.0).alias("fund_fine"), fee.alias("fee_rate"))


@query("SELECT case_id, cast(least(90, 30 + 3 * least(20, floor((left_on - hired_on) / 365))) AS INT) AS days FROM cases", "cases")
def notice_days(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", derive.notice_days(F.col("hired_on"), F.col("left_on")).alias("days"))


_BRACKETS = ", ".join(f"({i + 1}, {a}, {b:.2f}, {r}, {d})" for i, (a, b, r, d) in enumerate(catalogs.BRACKETS))


@query(f"SELECT case_id, band, reais * rate / 100 - deduction AS tax FROM cases JOIN (VALUES {_BRACKETS}) b(band, lo, hi, rate, deduction) ON reais >= lo AND reais < hi", "cases")
def bracket_tax(spark, sf_dir):
    bands = spark.createDataFrame([(i + 1, float(a), float(b), float(r), float(d)) for i, (a, b, r, d) in enumerate(catalogs.BRACKETS)], "band int, lo double, hi double, rate double, deduction double")
    rows = derived(spark, sf_dir, "cases").select("case_id", "reais")
    return rows.join(F.broadcast(bands), (F.col("reais") >= F.col("lo")) & (F.col("reais") < F.col("hi"))).select("case_id", "band", (F.col("reais") * F.col("rate") / 100 - F.col("deduction")).alias("tax"))


@query("SELECT case_id, item_no, case when amount <= 3 * reais then 'light' when amount <= 5 * reais then 'medium' when amount <= 20 * reais then 'grave' when amount <= 50 * reais then 'gravest' else 'above' end AS band FROM items JOIN cases USING (case_id) WHERE name = 'Dano moral'", "items cases")
def damage_band(spark, sf_dir):
    damage = derived(spark, sf_dir, "items").where(text.canonical_name(F.col("name")) == "Dano Moral").select("case_id", "item_no", "amount")
    return damage.join(derived(spark, sf_dir, "cases").select("case_id", "reais"), "case_id").select("case_id", "item_no", derive.damage_band(F.col("amount"), F.col("reais")).alias("band"))


@query("SELECT case_id, (epoch_ms(cast(filed_on AS timestamp)) + 10800000)::BIGINT AS filed_ms FROM cases", "cases")
def epoch_ms(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", derive.epoch_ms(F.col("filed_on")).alias("filed_ms"))


@query(f"""SELECT c.case_id, c.number, c.rate_index, count(i.item_no) AS n_items, coalesce(string_agg(i.name, '|' ORDER BY i.item_no), '') AS item_names,
  coalesce(string_agg(i.name, '|' ORDER BY i.item_no) FILTER (WHERE i.canonical in ('Adicional Noturno', 'Horas Extras')), '') AS surcharges
  FROM cases c LEFT JOIN (SELECT case_id, item_no, name, {CANON} AS canonical FROM items) i USING (case_id) GROUP BY ALL""", "cases items")
def case_view(spark, sf_dir):
    items = derived(spark, sf_dir, "items").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "name"))).alias("items"))
    rows = derived(spark, sf_dir, "cases").select("case_id", "number", "rate_index").join(items, "case_id", "left")
    names = F.transform("items", lambda x: x["name"])
    surcharge = F.filter(names, lambda n: text.canonical_name(n).isin("Adicional Noturno", "Horas Extras"))
    return rows.select("case_id", "number", "rate_index", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(names, "|"), F.lit("")).alias("item_names"), F.coalesce(F.array_join(surcharge, "|"), F.lit("")).alias("surcharges"))
