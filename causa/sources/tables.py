"""Tables by name, and the case, item and page tables derived from the supplied ones.

Orders stand for cases and line items for granted items and pages. The derived
tables are declared once, in SQL that Spark and the comparison engine both read,
and stay lazy: Catalyst prunes the columns that a query doesn't use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from causa import reach_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dmy(d: str) -> str:
    """SQL: a date as DD/MM/YYYY."""
    return f"lpad(cast(day({d}) as string), 2, '0') || '/' || lpad(cast(month({d}) as string), 2, '0') || '/' || cast(year({d}) as string)"


def pick(key: str, values: list[str]) -> str:
    """SQL: one of some literals by a key modulo their number."""
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case cast({key} as bigint) % {len(values)} {whens} end"


def _quoted(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


_CASE_DATES = """
SELECT o_orderkey AS case_id, o_custkey AS cust_id, o_orderstatus AS status, o_totalprice AS price, cast(o_orderdate as date) + 8036 AS filed_on,
  cast(o_orderdate as date) + 8036 - cast(430 + o_orderkey % 2900 as int) AS hired_on, cast(o_orderdate as date) + 8036 - cast(o_orderkey % 420 as int) AS left_on,
  cast(o_orderdate as date) + 8036 + cast(150 + o_orderkey % 600 as int) AS ruled_on, cast(round(o_totalprice / 100) as bigint) AS reais,
  lpad(cast(o_orderkey % 10000000 as string), 7, '0') AS seq, lpad(cast(o_custkey % 10000 as string), 4, '0') AS origin
FROM orders"""

_CASES = f"""
SELECT case_id, cust_id, status, price, filed_on, hired_on, left_on, ruled_on, reais,
  seq || '-' || lpad(cast((98 - (cast(seq || cast(year(filed_on) as string) || '504' || origin as bigint) % 97 * 3) % 97 + case when case_id % 7 = 0 then 1 else 0 end) % 100 as string), 2, '0')
    || '.' || cast(year(filed_on) as string) || '.5.04.' || origin AS number,
  {pick("case_id", _quoted("TR", "IPCA-E", "SELIC", "IPCA-E e SELIC", "n/a"))} AS rate_index,
  {pick("case_id + cust_id", _quoted("juros de 1% ao mês", "juros pela SELIC", "juros legais", "-"))} AS interest,
  {pick("cust_id", _quoted("sem justa causa", "com justa causa", "rescisão indireta", "pedido de demissão"))} AS reason,
  {pick("case_id + 1", _quoted("30", "33 dias", "120 dias", "15 dias", ""))} AS notice,
  {pick("case_id", _quoted("10%", "15%", "20%", "3%", "null"))} AS fee,
  {pick("cust_id + 2", _quoted("sim", "não", "true", "False", "talvez", " SIM "))} AS free_justice,
  {pick("case_id + cust_id", _quoted("das 08:00 às 18:00 com 1 h de intervalo", "das 9h às 18h", "das 22:00 às 06:00", "livre"))} AS schedule,
  {pick("case_id", _quoted("44 horas semanais", "40 horas semanais", "36 horas semanais", "divisor de 200", "-"))} AS hours,
  {pick("case_id + 2", ["'SIM'", "'NAO_INCIDE'", "cast(null as string)", "cast(null as string)"])} AS fund_on_notice, {pick("cust_id", ["'NAO_INCIDE'", "cast(null as string)", "cast(null as string)", "'INCIDE'"])} AS fund_on_vacation,
  {pick("case_id + cust_id", ["'INCIDE'", "cast(null as string)", "cast(null as string)", "cast(null as string)"])} AS fine_on_notice,
  case_id % 3 = 0 AS deducts, {pick("cust_id", _quoted("recibos de férias", "", " valores pagos "))} AS deduction_note, left_on + cast(case_id % 40 - 5 as int) AS book_exit_on,
  case case_id % 13 when 0 then 'R$ ' || cast(reais as string) || ',00 de Salario complessivo' when 1 then 'a apurar' when 2 then '' else 'R$ ' || cast(reais as string) || ',00' end AS pay,
  {pick("cust_id + 1", _quoted("", "homologação sindical é obrigatória", "homologação sindical realizada", "Nulidade por falta de homologacao", ""))} AS book_note, {pick("case_id", _quoted("", "depósitos em dia", "rescisão condicionada a homologação"))} AS fund_note
FROM case_dates"""

_TEXTS = f"""
SELECT case_id, cust_id,
  'Processo: ' || number || '. 12ª Vara do Trabalho de Porto Alegre. O reclamante foi admitido em ' || {dmy("hired_on")} || ' e dispensado em ' || {dmy("left_on")} || ' ' || reason
  || '. Recebia salário de R$ ' || cast(reais as string) || ',00 por mês. ' || 'Salário contratual de R$ ' || cast(reais + 100 as string) || ',00. Última remuneração de R$ ' || cast(reais as string) || ',00. '
  || 'Jornada ' || schedule || '; ' || hours || '. Aviso prévio indenizado de ' || notice || '. '
  || case when cust_id % 3 = 0 then 'Defiro ao autor o benefício da justiça gratuita. ' when cust_id % 3 = 1 then 'Não faz jus à justiça gratuita. ' else '' end
  || 'Distribuída em ' || {dmy("filed_on")} || '. Juíza do Trabalho: Dra. Ana Maria Lima; Advogado do reclamante: Dr. João Paulo Reis, Advogada da reclamada: Dra. Rita Nunes, exercia a função de ' || {pick("cust_id", _quoted("auxiliar", "vendedor", "motorista"))} || '. '
  || case when cust_id % 5 = 0 then 'Contrato de experiência. ' when cust_id % 5 = 1 then 'Contrato por prazo determinado. ' else '' end
  || 'Atualização por ' || rate_index || ' e ' || interest || '. Rito ' || case when case_id % 2 = 0 then 'ordinário' else 'sumaríssimo' end || '. '
  || case when case_id % 4 <> 3 then 'Assinado eletronicamente por A em ' || {dmy("ruled_on")} || '. Assinado eletronicamente por B em ' || {dmy("filed_on")} || '. ' else 'Porto Alegre, 12 de março de 2024. ' end
  || 'Conforme Súmula n° 264 do TST e OJ n° 394; art. 477 da CLT. Lei n° 12.506.' AS text
FROM cases"""

_ITEMS = f"""
SELECT l_orderkey AS case_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS item_no,
  {pick("l_partkey", _quoted("Horas Extras", "hora extra 50%", "Férias + 1/3", "13º salário", "FGTS + multa de 40%", "DSR", "Aviso Prévio", "adicional noturno", "Multa do art. 477", "Dano moral", "Saldo de salário", " Vale transporte ", "Aviso Prévio Indenizado", "Férias indenizadas + 1/3", "Horas In Itinere", "Tempo de deslocamento"))} AS name,
  case l_returnflag when 'A' then 'deferida' when 'R' then 'indeferida' when 'N' then case when l_partkey % 2 = 0 then 'parcialmente deferida' else '' end end AS status,
  lpad(cast(month(l_shipdate) % 3 + 1 as string), 2, '0') || '/2020' AS period,
  cast(l_discount * 100 as int) AS percent, cast(l_quantity as int) AS quantity, l_extendedprice AS amount, l_tax AS tax,
  case when l_linestatus = 'O' then true else false end AS integrates,
  {pick("l_suppkey", _quoted("", "férias, 13º salário e FGTS", "DSR, FGTS e aviso prévio", "Horas Extras"))} AS reflexes, l_partkey AS part_id, l_suppkey AS supp_id
FROM lineitem"""

_CALC = """
SELECT case_id, item_no, case when item_no % 3 = 0 then lower(trim(name)) || ' e reflexos' when item_no % 3 = 1 then upper(name) else name end AS name, amount
FROM items WHERE tax < 0.05"""

_CASE_PAGES = f"""
SELECT case_id AS doc_id, item_no AS page_no,
  {pick("part_id", _quoted("Fica V. Sa. intimado da decisão.", "RELATÓRIO. VISTOS, etc.", "FUNDAMENTAÇÃO. Quanto às horas extras, assiste razão.", "DISPOSITIVO. ANTE O EXPOSTO, JULGO PROCEDENTE o pedido.", "PROCURAÇÃO", "Continuação do texto da folha.", "embargos de declaração com efeito infringente", "ACÓRDÃO. Desembargador relator.", "Homologação de cálculos apresentados.", "Cumpra-se. Expeça-se RPV."))}
  || case when supp_id % 4 <> 0 then ' Assinado eletronicamente por X em ' || {dmy("(date '2021-01-01' + cast(case_id % 300 + case when supp_id % 3 = 0 then 45 else 0 end as int))")} else '' end AS text
FROM items"""

_DOSSIER_PAGES = f"""
SELECT doc_id, page_no, case when doc_id % 3 = 0 and page_no = 1 then 'SUMÁRIO' || chr(10) || 'Petição inicial  01/02/2020  Pág. 2' || chr(10) || 'Contestação  05/02/2020  ' || cast(2 + doc_id % 2 as string) || chr(10)
    || case when doc_id % 4 <> 3 then 'Sentença  10/03/2020  pag 4' || chr(10) || 'Sentença de embargos  11/04/2020  ' || cast(3 + doc_id % 5 as string) || chr(10) else '' end || 'Ofício  123456' || chr(10) || 'Cálculos de liquidação ' || cast(5 + doc_id % 60 as string)
  else text || ' ' || {pick("doc_id + page_no", _quoted("EXCELENTÍSSIMO SENHOR JUIZ", "Nestes termos", "CONTESTAÇÃO da reclamada", "Requer a improcedência", "RESUMO DO CÁLCULO", "PARECER TÉCNICO", "folha", "verso"))} end AS text
FROM case_pages"""

_CASE_RECORDS = f"""
SELECT case_id, case_id % 2 + 1 AS version, case case_id % 2
  when 0 then '{{"number":"' || number || '","reason":"' || reason || '","pay":{{"reais":' || cast(reais as string) || ',"terms":"' || pay || '"}},"dates":[{{"kind":"hired","on":"' || {dmy("hired_on")} || '"}},{{"kind":"left","on":"' || {dmy("left_on")} || '"}}]}}'
  else '{{"pay":{{"terms":"' || pay || '","reais":"' || cast(reais as string) || '"}},"number":"' || number || '","dates":[{{"on":"' || {dmy("hired_on")} || '","kind":"hired","page":' || cast(case_id % 9 as string) || '}}],"deducts":' || case when deducts then 'true' else 'false' end || case when case_id % 3 = 0 then ',"note":{{"text":"' || deduction_note || '"}}' else '' end || '}}' end AS record
FROM cases"""

_TIERED_TEXTS = f"""
SELECT case_id, cust_id, number, filed_on, ruled_on,
  case case_id % 3 when 0 then 'Ref. 0000001-11.2020.5.04.0001. Processo: ' || number when 1 then 'Visto ' || number || ' e 0000001-11.2020.5.04.0001' else 'sem registro' end || '. '
  || case case_id % 4 when 0 then 'Assinado eletronicamente por A em ' || {dmy("ruled_on")} || '. Assinado digitalmente por B em ' || {dmy("filed_on")} || '. Publicado em 01/02/2020. ' when 1 then 'Publicada em ' || {dmy("ruled_on")} || '. Canoas, 1 de maio de 2020. '
    when 2 then 'Canoas, 40 de maio de 2020. Esteio, 12  de Março de 2024. ' else '' end
  || {pick("cust_id", _quoted("O pedido de demissão foi convertido em rescisão indireta. ", "Com justa causa, diz a ré; foi dispensado sem justa causa. ", "Sem justa causa, diz o autor; foi com justa causa. ", "Demitiu-se. ", "Término do prazo do contrato. ", "Sem notícia. "))}
  || {pick("case_id + 1", _quoted("Período de experiência; vínculo de emprego. ", "Contrato de trabalho com prazo determinado. ", "Houve pejotização, que se reconhece como fraude. ", "Autônomo, vínculo que se reconhece. ", "Regido pela CLT. ", "Nada consta. "))}
  || {pick("case_id + cust_id", _quoted("Aviso prévio proporcional de 33 (trinta e três) dias.", "São 45 dias de aviso previo.", "Aviso prévio de 120 dias, ou 30 dias de aviso prévio.", "Aviso prévio 19 dias.", "Aviso prévio de 20 dias.", "Sem aviso."))} AS text
FROM cases"""

_PARAM_YEARS = "SELECT DISTINCT cast(year(filed_on) as int) AS y, cast((SELECT max(year(filed_on)) FROM case_dates) as int) AS last FROM case_dates"

_PARAM_RECORDS = """
SELECT y, 'wage' AS kind, '{"id":"minimum_wage_' || cast(y as string) || '","valor":' || cast(900 + 50 * (y - 2010) as string) || '.50,"vigencia":{"inicio":"' || cast(y as string) || '-01-01","fim":'
  || case when y = last then 'null' when y % 4 = 3 then '"' || cast(y as string) || '-06-30"' else '"' || cast(y as string) || '-12-31"' end || '}}' AS record FROM param_years
UNION ALL
SELECT y, 'bands' AS kind, '{"faixas":[{"faixa":1,"base_calculo_ate":' || cast(1000 + y % 10 * 10 as string) || '.00,"aliquota":0.0,"deducao":0.0},{"faixa":2,"base_calculo_de":' || cast(1000 + y % 10 * 10 as string)
  || '.01,"base_calculo_ate":2000.00,"aliquota":0.075,"deducao":75.00},{"faixa":3,"base_calculo_de":2000.01,"aliquota":0.15,"deducao":225.10}],"id":"income_tax_' || cast(y as string) || '","vigencia":{"inicio":"'
  || cast(y as string) || '-02-01","fim":' || case when y = last then 'null' else '"' || cast(y + 1 as string) || '-01-31"' end || '}}' AS record FROM param_years"""

#: Name -> SQL over the supplied tables and other derived ones.
DERIVED = {"case_dates": _CASE_DATES, "cases": _CASES, "texts": _TEXTS, "items": _ITEMS, "calc": _CALC, "case_pages": _CASE_PAGES, "dossier_pages": _DOSSIER_PAGES, "case_records": _CASE_RECORDS, "tiered_texts": _TIERED_TEXTS, "param_years": _PARAM_YEARS, "param_records": _PARAM_RECORDS}
_SUPPLIED = ("orders", "lineitem")


def needs(name: str) -> list[str]:
    return re.findall(r"FROM (\w+)", DERIVED[name])


def with_needs(names: list[str]) -> list[str]:
    """Derived tables in an order in which each finds those that it reads."""
    out: list[str] = []
    for n in names:
        for x in (*with_needs([y for y in needs(n) if y in DERIVED]), n):
            if x not in out:
                out.append(x)
    return out


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = {n: table(spark, sf_dir, n) if n in _SUPPLIED else derived(spark, sf_dir, n) for n in needs(name)}
    plain = DERIVED[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", plain), **read)
