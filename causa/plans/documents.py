"""Queries on pages, sections, documents and extracted fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import text
from causa.operators import fields, pages, tiered
from causa.plans.normalise import q, sql_norm
from causa.plans.registry import query
from causa.sources.tables import derived, dmy, table

_FLAGS = ", ".join(f"regexp_matches(text, {q(p)}) AS \"{n}\"" for n, p in catalogs.PAGE_FLAGS.items())
_SIGNED = f"CAST(try_strptime(nullif(regexp_extract(text, {q(catalogs.SIGNED_ON)}, 1), ''), '%d/%m/%Y') AS DATE)"
def _pages_of(source: str) -> str:
    return f"SELECT doc_id, page_no, {_SIGNED} AS signed_on, {_FLAGS} FROM {source}"


_PAGES = _pages_of("case_pages")


def flags(spark, sf_dir):
    return pages.page_flags(derived(spark, sf_dir, "case_pages"))


@query(f"SELECT doc_id, page_no, {_FLAGS} FROM case_pages", "case_pages")
def page_flags(spark, sf_dir):
    return flags(spark, sf_dir).drop("signed_on")


@query(f"SELECT doc_id, page_no, {_SIGNED} AS signed_on FROM case_pages", "case_pages")
def page_sigdate(spark, sf_dir):
    return flags(spark, sf_dir).select("doc_id", "page_no", "signed_on")


def _runs_of(source: str) -> str:
    return f"SELECT *, page_no - row_number() OVER (PARTITION BY doc_id, signed_on ORDER BY page_no) AS run FROM ({_pages_of(source)})"


_RUNS = _runs_of("case_pages")


@query(f"SELECT doc_id, page_no, signed_on, min(page_no) OVER (PARTITION BY doc_id, signed_on, run) AS block FROM ({_RUNS})", "case_pages")
def page_islands(spark, sf_dir):
    return pages.islands(flags(spark, sf_dir)).select("doc_id", "page_no", "signed_on", "block")


def _block_of(source: str) -> str:
    return f"""SELECT doc_id, signed_on, min(page_no) AS first_page, max(page_no) AS last_page FROM ({_runs_of(source)}) WHERE signed_on IS NOT NULL GROUP BY doc_id, signed_on, run
  HAVING bool_or(ruling) AND NOT arg_min(envelope, page_no) AND avg(CAST(envelope AS INT)) <= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY signed_on DESC, first_page) = 1"""


_BLOCK = _block_of("case_pages")


def _fallback_of(source: str) -> str:
    """A walk: each step finds the next beginning that lies behind the block before it."""
    return f"""WITH RECURSIVE p AS ({_pages_of(source)}), c AS (SELECT *, envelope AND NOT ruling AS pure, sum(CAST(envelope AND NOT ruling AS INT)) OVER (PARTITION BY doc_id ORDER BY page_no) AS part FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY page_no) AS i FROM c WHERE NOT pure), s AS (SELECT doc_id, part, i FROM k WHERE (opening OR ruling) AND NOT envelope),
  h AS (SELECT doc_id, part, min(i) AS i FROM s GROUP BY ALL UNION ALL SELECT h.doc_id, h.part, min(s.i) AS i FROM h JOIN s ON s.doc_id = h.doc_id AND s.part = h.part AND s.i >= h.i + 60 GROUP BY h.doc_id, h.part, h.i),
  b AS (SELECT h.doc_id, min(page_no) AS first_page, max(page_no) AS last_page FROM h JOIN k ON k.doc_id = h.doc_id AND k.part = h.part AND k.i >= h.i AND k.i < h.i + 60 GROUP BY h.doc_id, h.part, h.i HAVING bool_or(ruling))
  SELECT doc_id, max(first_page) AS first_page, arg_max(last_page, first_page) AS last_page FROM b GROUP BY doc_id"""


def _last_of(source: str) -> str:
    return f"""WITH p AS (SELECT *, max(page_no) FILTER (WHERE opening AND NOT envelope) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS opened FROM ({_pages_of(source)})),
  e AS (SELECT doc_id, min(page_no) AS low, max(page_no) AS high, max(page_no) FILTER (WHERE ruling) AS lastp, arg_max(opened, page_no) FILTER (WHERE ruling AND opened IS NOT NULL) AS x, max(opened) FILTER (WHERE ruling) AS opened FROM p GROUP BY doc_id)
  SELECT doc_id, coalesce(case when opened >= lastp - 25 then opened end, lastp, low) AS first_page, coalesce(least(lastp + 5, high), high) AS last_page FROM e"""


@query(_BLOCK, "case_pages")
def decision_block(spark, sf_dir):
    return pages.decision_block(flags(spark, sf_dir))


@query(_fallback_of("case_pages"), "case_pages")
def block_fallback(spark, sf_dir):
    return pages.fallback_block(flags(spark, sf_dir))


@query(_last_of("case_pages"), "case_pages")
def block_last_ruling(spark, sf_dir):
    return pages.last_ruling_block(flags(spark, sf_dir))


@query(f"""SELECT doc_id, case when bool_or(motion) then 'motion' when bool_or(settlement) then 'settlement' when bool_or("order") then 'order' when bool_or(appeal) then 'appeal' else 'sentence' end AS kind FROM ({_PAGES}) GROUP BY doc_id""", "case_pages")
def doc_kind(spark, sf_dir):
    return pages.document_kind(flags(spark, sf_dir))


@query(f"""WITH b AS ({_BLOCK}) SELECT p.doc_id, string_agg('[p. ' || page_no || '] ' || text, chr(10) ORDER BY page_no) AS text FROM case_pages p JOIN b ON p.doc_id = b.doc_id
  WHERE page_no BETWEEN first_page - 3 AND last_page OR page_no <= 2 GROUP BY p.doc_id""", "case_pages")
def block_text(spark, sf_dir):
    return pages.block_text(pages.decision_block(flags(spark, sf_dir)), derived(spark, sf_dir, "case_pages"))


_SECTIONS = (("rulings", "the of"), ("rulings", "de la"), ("orders", "der die"), ("orders", "los que"), ("terms", "license"))


@query(f"""WITH d AS (SELECT doc_id, {sql_norm('text')} AS t FROM documents), c(rank, section, word) AS (VALUES {', '.join(f"({i}, {q(s)}, {q(w)})" for i, (s, w) in enumerate(_SECTIONS))})
  SELECT doc_id, section, word, strpos(t, word) - 1 AS pos FROM d, c WHERE contains(t, word) QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY rank) = 1""")
def section_exact(spark, sf_dir):
    """First synonym in list order that a text holds, and where, on normalised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.array(text.norm_text(F.col("text"))), lambda t: F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("section"), F.lit(w).alias("word"), (F.instr(t, w) - 1).alias("pos")) for i, (s, w) in enumerate(_SECTIONS))))[0].alias("found"))
    hits = docs.select("doc_id", F.explode(F.filter("found", lambda x: x["pos"] >= 0)).alias("f")).select("doc_id", "f.*")
    return hits.groupBy("doc_id", "section").agg(F.min_by("word", "rank").alias("word"), F.min_by("pos", "rank").cast("long").alias("pos"))


_CONTENTS = f"""SELECT doc_id, kind, first_page, greatest(least(last_entry + 8, coalesce(lead(first_page) OVER (PARTITION BY doc_id ORDER BY first_page, seen) - 1, pages), pages), first_page) AS last_page FROM (
  SELECT doc_id, pages, kind, arg_min(page, (page_no, line_no)) AS first_page, min((page_no, line_no)) AS seen, max(page) AS last_entry FROM (
    SELECT doc_id, pages, page_no, line_no, case {' '.join(f"when regexp_matches(line, {q(p.replace('(?iu)', '(?i)'))}) then '{k}'" for k, p in catalogs.CONTENTS_KINDS)} end AS kind,
      try_cast(regexp_extract(line, '(?i)\\b(?:p[aáÁ]g\\.?)?\\s*(\\d{{1,4}})\\s*$', 1) AS INT) AS page
    FROM (SELECT doc_id, pages, page_no, unnest(range(len(l))) AS line_no, trim(unnest(l)) AS line FROM (
      SELECT doc_id, page_no, max(page_no) OVER (PARTITION BY doc_id) AS pages, string_split(text, chr(10)) AS l, bool_or(page_no <= 15 AND upper(text) LIKE '%SUMÁRIO%') OVER (PARTITION BY doc_id) AS headed FROM dossier_pages) WHERE headed AND page_no <= 15)
    WHERE length(line) >= 5) WHERE kind IS NOT NULL AND page >= 1 GROUP BY doc_id, pages, kind)"""


@query(_CONTENTS, "dossier_pages")
def toc_slices(spark, sf_dir):
    """Pieces of a file by its table of contents."""
    return pages.contents(derived(spark, sf_dir, "dossier_pages"))


_RANGES = """WITH m AS (SELECT doc_id, page_no, text LIKE '%FUNDAMENTA%' AS s, text LIKE '%Continua%' AS e, max(page_no) OVER (PARTITION BY doc_id) AS pages FROM case_pages),
  f AS (SELECT *, min(page_no) FILTER (WHERE s) OVER (PARTITION BY doc_id) AS first_page FROM m)
  SELECT doc_id, first_page, coalesce(min(page_no) FILTER (WHERE e AND page_no > first_page AND page_no < first_page + 80), least(first_page + 79, pages)) AS last_page FROM f WHERE first_page IS NOT NULL GROUP BY doc_id, first_page, pages"""


@query(_RANGES, "case_pages")
def anchor_ranges(spark, sf_dir):
    return pages.anchor_ranges(derived(spark, sf_dir, "case_pages"), "FUNDAMENTA", "Continua")


@query(f"WITH r AS ({_RANGES}) SELECT p.doc_id, substr(string_agg(text, chr(10) ORDER BY page_no), 1, 120000) AS text FROM case_pages p JOIN r ON p.doc_id = r.doc_id AND page_no BETWEEN first_page AND last_page GROUP BY p.doc_id", "case_pages")
def slice_text(spark, sf_dir):
    ranges = pages.anchor_ranges(derived(spark, sf_dir, "case_pages"), "FUNDAMENTA", "Continua")
    rows = derived(spark, sf_dir, "case_pages").join(ranges, "doc_id").where("page_no between first_page and last_page")
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n"), 1, 120000).alias("text"))


def _anchor_sql(kind: str, start: str, end: str | None) -> str:
    last = "least(max(first_page) + 30, max(pages))" if end is None else f"coalesce(min(page_no) FILTER (WHERE regexp_matches(text, {q(end.replace('(?iu)', '(?i)'))}) AND page_no > first_page AND page_no < first_page + 80), least(max(first_page) + 79, max(pages)))"
    first = f"min(page_no) FILTER (WHERE regexp_matches(text, {q(start.replace('(?iu)', '(?i)'))})) OVER (PARTITION BY doc_id)"
    return f"SELECT doc_id, '{kind}' AS kind, max(first_page) AS first_page, {last} AS last_page FROM (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS pages, {first} AS first_page FROM dossier_pages) WHERE first_page IS NOT NULL GROUP BY doc_id"


@query(f"""WITH c AS ({_CONTENTS}), a AS ({' UNION ALL '.join(_anchor_sql(*x) for x in catalogs.ANCHORS)}),
  n AS (SELECT *, 'contents' AS origin FROM c UNION ALL SELECT *, 'anchor' AS origin FROM a WHERE doc_id NOT IN (SELECT doc_id FROM c)),
  b AS (SELECT doc_id, arg_min(first_page, rank) AS first_page, arg_min(last_page, rank) AS last_page FROM (
    SELECT 0 AS rank, doc_id, first_page, last_page FROM ({_block_of("dossier_pages")}) UNION ALL SELECT 1, * FROM ({_fallback_of("dossier_pages")}) UNION ALL SELECT 2, * FROM ({_last_of("dossier_pages")})) GROUP BY doc_id),
  k AS (SELECT p.doc_id, case when bool_or(motion) or bool_or(settlement) or bool_or("order") or not bool_or(appeal) then 'sentence' else 'appeal' end AS kind, b.first_page, b.last_page
    FROM ({_pages_of("dossier_pages")}) p JOIN b ON p.doc_id = b.doc_id AND page_no BETWEEN first_page AND last_page GROUP BY ALL)
  SELECT doc_id, kind, origin, first_page, last_page FROM n UNION ALL SELECT doc_id, kind, 'block', first_page, last_page FROM k WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE kind IN ('sentence', 'appeal'))""", "dossier_pages")
def timeline(spark, sf_dir):
    """Pieces by contents, else by anchors; the decision block where neither names a decision."""
    return pages.timeline(derived(spark, sf_dir, "dossier_pages"))


@query(r"""SELECT doc_id, case when n = 0 then length(text) when n1 > 0 then n1 - 1 else length(text) end AS kept_chars FROM (
  SELECT doc_id, text, len(regexp_extract_all(text, '(?i)licen[sc]e')) AS n, case when regexp_matches(text, '(?i)licen[sc]e') then length(regexp_extract(text, '(?is)^(.*?)licen[sc]e', 1)) + 1 else 0 end AS n1 FROM documents)""")
def cut_repeats(spark, sf_dir):
    """Text before the first notice marker."""
    at = F.regexp_instr("text", F.lit("(?i)licen[sc]e"))
    kept = F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("kept_chars"))


_LABELLED = "SELECT doc_id, string_agg(case when page_no % 4 = 3 then repeat('- ', 160) else '--- PÁGINA ' || page_no || ' ---' || chr(10) end || text || case when page_no % 5 = 4 then chr(10) || 'Certidão de Disponibilização e Publicação' else '' end, chr(10) ORDER BY page_no) AS text FROM case_pages GROUP BY doc_id"
_R = catalogs.REPEAT_RULING.replace("(?iu)", "")


@query(f"""WITH t AS ({_LABELLED}), n AS (SELECT doc_id, text, regexp_matches(text, {q(catalogs.REPEAT_NOTICE.replace("(?iu)", "(?i)"))}) AS noticed,
    regexp_extract(text, {q("(?is)^(.*?)" + catalogs.REPEAT_NOTICE.replace("(?iu)", ""))}, 1) AS before, regexp_extract(text, {q(f"(?is)^(.*?{_R}.*?){_R}")}, 1) AS once FROM t),
  c AS (SELECT doc_id, case when noticed then before when once = '' then text when regexp_matches(once, '(?s)--- PÁGINA.{{0,290}}$') then regexp_extract(once, '(?s)^(.*)--- PÁGINA', 1) else once end AS kept, noticed OR once <> '' AS cut FROM n)
  SELECT doc_id, cut, length(k) AS kept_chars, md5(k) AS kept_md5 FROM (SELECT doc_id, cut, case when cut then regexp_replace(kept, '\\s+$', '') else kept end AS k FROM c)""".replace("\\\\", "\\"), "case_pages")
def cut_repeat_pages(spark, sf_dir):
    """Labelled pages of a document without the repeated tail: up to a notice, else up to the page of the second ruling."""
    n = F.col("page_no")
    label = F.when(n % 4 == 3, "- " * 160).otherwise(F.concat(F.lit(f"{catalogs.PAGE_LABEL} "), n.cast("string"), F.lit(" ---\n")))
    page = F.concat(label, "text", F.when(n % 5 == 4, "\nCertidão de Disponibilização e Publicação").otherwise(""))
    pages_of = derived(spark, sf_dir, "case_pages").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", page.alias("page")))).alias("p"))
    whole = pages_of.select("doc_id", F.array_join(F.transform("p", lambda p: p["page"]), "\n").alias("whole"))
    kept = whole.withColumn("kept", text.cut_repeat(F.col("whole"), catalogs.REPEAT_NOTICE, catalogs.REPEAT_RULING, catalogs.PAGE_LABEL))
    return kept.select("doc_id", (F.col("kept") != F.col("whole")).alias("cut"), F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, strpos(lower(text), 'license') AS pos FROM documents)
  SELECT doc_id, md5(case when n <= 2500 then text else substr(text, 1, 1000) || case when pos > 0 then substr(text, greatest(1000, pos - 500) + 1, 1500) else substr(text, n - 1499) end end) AS excerpt_md5 FROM d""")
def excerpt_budget(spark, sf_dir):
    """40 % of the budget from the head; the rest from a window round the mark, else from the tail."""
    budget, head = 2500, 1000
    at = F.instr(F.lower("text"), "license")
    rest = F.when(at > 0, F.substring("text", F.greatest(F.lit(head), at - 500) + 1, F.lit(budget - head))).otherwise(F.right("text", F.lit(budget - head)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.when(F.length("text") <= budget, F.col("text")).otherwise(F.concat(F.substring("text", 1, head), rest))).alias("excerpt_md5"))


@query(r"""SELECT doc_id, case when len(regexp_extract_all(substr(text, 1, 6000), '\d{4,}')) >= 2 then 'sampling' when regexp_matches(substr(text, 1, 6000), '(?i)licen[sc]e') then 'opinion' when contains(substr(text, 1, 6000), '@') then 'statement' else 'other' end AS kind FROM documents""")
def evidence_kind(spark, sf_dir):
    head = F.substring("text", 1, 6000)
    kind = F.when(F.regexp_count(head, F.lit(r"\d{4,}")) >= 2, "sampling").when(head.rlike("(?i)licen[sc]e"), "opinion").when(head.contains("@"), "statement").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query("""WITH k AS (SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1), e AS (SELECT DISTINCT user_id, 'click' AS event_type, -user_id AS event_id FROM events WHERE user_id % 3 = 0)
  SELECT coalesce(e.user_id, k.user_id) AS user_id, coalesce(e.event_type, k.event_type) AS slot, coalesce(e.event_id, k.event_id) AS file_id FROM k FULL JOIN e ON k.user_id = e.user_id AND k.event_type = e.event_type""")
def slot_fill(spark, sf_dir):
    """First file of each kind fills a slot; an explicit file wins."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("found"))
    explicit = events.where("user_id % 3 = 0").select("user_id", F.lit("click").alias("event_type"), (-F.col("user_id")).alias("given")).distinct()
    return first.join(explicit, ["user_id", "event_type"], "full").select("user_id", F.col("event_type").alias("slot"), F.coalesce("given", "found").alias("file_id"))


@query("""SELECT page_id, case when contains(url, '/de/') then 'superior' when contains(url, '/fr/') then 'regional' when contains(url, '/en/') then 'first' when contains(lower(substr(html, 1001)), 'regional') then 'regional' else 'unknown' end AS tier FROM pages""")
def tier_class(spark, sf_dir):
    """Level by name; the text after its head decides only if the name says nothing."""
    u = F.col("url")
    tier = F.when(u.contains("/de/"), "superior").when(u.contains("/fr/"), "regional").when(u.contains("/en/"), "first").when(F.lower(F.expr("substr(html, 1001)")).contains("regional"), "regional").otherwise("unknown")
    return table(spark, sf_dir, "pages").select("page_id", tier.alias("tier"))


@query("SELECT case_id, case when case_id % 4 <> 3 then ruled_on else date '2024-03-12' end AS doc_on FROM cases", "cases")
def doc_date(spark, sf_dir):
    """Signature date, else the date in words after a city, else 1900-01-01; filing lines don't count."""
    t = F.regexp_replace("text", r"(?im)^.*protocolad[oa] em.*$", "")
    signed = F.try_to_date(F.regexp_extract(t, catalogs.SIGNED_ON, 1), "dd/MM/yyyy")
    words = text.parse_date(F.regexp_extract(t, r"[A-Z][a-zã]+, (\d{1,2} de [a-zç]+ de \d{4})", 1))
    return derived(spark, sf_dir, "texts").select("case_id", F.coalesce(signed, words, F.lit("1900-01-01").cast("date")).alias("doc_on"))


@query("SELECT doc_id, first_id, first_id <> doc_id AS dropped FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)")
def content_dedup(spark, sf_dir):
    """First upload of each content; hashes are grouped with partial sums, so a large group of copies is no hot task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    first = docs.groupBy("content").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "content").select("doc_id", "first_id", (F.col("first_id") != F.col("doc_id")).alias("dropped"))


_STRETCH = "SELECT source, doc_id // 100 AS stretch, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS h FROM documents GROUP BY ALL"


@query(f"SELECT source, stretch, h AS dossier FROM ({_STRETCH})")
def dossier_hash(spark, sf_dir):
    """Hash of the sorted hashes of a dossier's files, whatever their order: a source's documents of one hundred ids."""
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("stretch"), F.sha2("text", 256).alias("part"))
    return rows.groupBy("source", "stretch").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256).alias("dossier"))


@query("""WITH t AS (SELECT user_id, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 4 end AS level, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
  SELECT user_id, string_agg(DISTINCT cast(level as string), ',' ORDER BY cast(level as string)) AS levels, max(level) AS last_level, bool_or(level = 4) AS has_top FROM t GROUP BY user_id""")
def title_levels(spark, sf_dir):
    e = F.col("event_type")
    level = F.when(e == "view", 1).when(e == "click", 2).when(e == "purchase", 3).otherwise(4)
    newest = table(spark, sf_dir, "events").groupBy("user_id", level.alias("level")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return newest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("level")), lambda x: x.cast("string")), ",").alias("levels"), F.max("level").alias("last_level"), F.bool_or(F.col("level") == 4).alias("has_top"))


@query("SELECT conv_id, md5(string_agg('[' || turn || '] ' || substr(coalesce(text, ''), 1, 8000), chr(10) ORDER BY turn)) AS dossier_md5 FROM conversations GROUP BY conv_id")
def dossier_concat(spark, sf_dir):
    part = F.struct("turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, 8000)).alias("s"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"]), "\n")).alias("dossier_md5"))


@query(r"SELECT case_id, number AS head_number, case when case_id % 4 = 3 then NULL else ruled_on end AS tail_date FROM cases", "cases")
def header_tail_fields(spark, sf_dir):
    head, tail = F.substring("text", 1, 3000), F.right("text", F.lit(2500))
    return derived(spark, sf_dir, "texts").select("case_id", fields.field(head, r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})").alias("head_number"), F.try_to_date(F.regexp_extract(tail, catalogs.SIGNED_ON, 1), "dd/MM/yyyy").alias("tail_date"))


@query(f"""WITH k AS (SELECT doc_id, case when bool_or(motion) then 'motion' when bool_or(settlement) then 'settlement' when bool_or("order") then 'order' when bool_or(appeal) then 'appeal' else 'sentence' end AS kind, bool_or(ruling) AS ruled FROM ({_PAGES}) GROUP BY doc_id)
  SELECT doc_id, case when ruled then kind else kind || '+full' end AS route FROM k""", "case_pages")
def route_kind(spark, sf_dir):
    ruled = flags(spark, sf_dir).groupBy("doc_id").agg(F.bool_or("ruling").alias("ruled"))
    return pages.document_kind(flags(spark, sf_dir)).join(ruled, "doc_id").select("doc_id", F.when(F.col("ruled"), F.col("kind")).otherwise(F.concat("kind", F.lit("+full"))).alias("route"))


@query("SELECT case_id, 'Súmula n° 264 do TST|OJ n° 394|art. 477 da CLT|Súmula n° 264|Lei n° 12.506.' AS citations FROM cases", "cases")
def citations(spark, sf_dir):
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p.replace("(?i)", "(?iu)", 1)), F.lit(0)) for p in catalogs.CITATIONS))
    return derived(spark, sf_dir, "texts").select("case_id", F.array_join(F.slice(F.array_distinct(found), 1, 20), "|").alias("citations"))


@query("""SELECT doc_id, list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: substr(x, 1, 250)), lambda x: length(x) > 20 AND regexp_matches(x, '(?i)\\b(but|aber|pero|mais|for)\\b'))[1:10], 'string_agg', '|') AS lines FROM documents""".replace("\\\\", "\\"))
def contrast_lines(spark, sf_dir):
    found = F.filter(F.transform(F.split("text", "\n"), lambda x: F.substring(x, 1, 250)), lambda x: (F.length(x) > 20) & x.rlike(r"(?i)\b(but|aber|pero|mais|for)\b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(F.slice(found, 1, 10), "|"), F.lit("")).alias("lines"))


@query(r"SELECT case_id, regexp_matches(interest || ' ' || fee || ' ' || notice, '(?i)(\d+%|taxa|dias)') AS mathematical FROM cases", "cases")
def math_argument(spark, sf_dir):
    return derived(spark, sf_dir, "cases").select("case_id", F.concat_ws(" ", "interest", "fee", "notice").rlike(r"(?i)(\d+%|taxa|dias)").alias("mathematical"))


# fields

_GENERIC = [(n, p, t, 1 if n in ("token", "license") else 0) for n, p, t in catalogs.GENERIC_FIELDS]
_LONG = " UNION ALL ".join(f"SELECT doc_id, {q(n)} AS field, regexp_extract(text, {q(p)}, {g}) AS value, {q(t)} AS tier FROM documents WHERE regexp_extract(text, {q(p)}, {g}) <> ''" for n, p, t, g in _GENERIC)


@query("SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(text, {q(p)}, {g}), '') AS {n}" for n, p, _, g in _GENERIC) + " FROM documents")
def extract_fields(spark, sf_dir):
    return fields.extract_wide(table(spark, sf_dir, "documents"), catalogs.GENERIC_FIELDS)


@query(_LONG)
def extract_long(spark, sf_dir):
    return fields.extract_long(table(spark, sf_dir, "documents"), catalogs.GENERIC_FIELDS)


@query(f"SELECT d.lang, l.field, count(*) AS found, round(count(*) * 1.0 / any_value(n), 6) AS rate FROM ({_LONG}) l JOIN documents d USING (doc_id) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) t ON t.lang = d.lang GROUP BY d.lang, l.field")
def field_fill_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _, _ in catalogs.GENERIC_FIELDS]
    wide = docs.select("lang", *(fields.field(F.col("text"), p).isNotNull().cast("long").alias(n) for n, p, _ in catalogs.GENERIC_FIELDS))
    sums = wide.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names))
    return sums.select("lang", "n", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("found")) for n in names))).alias("f")).where("f.found > 0").select("lang", "f.field", "f.found", F.round(F.col("f.found") / F.col("n"), 6).alias("rate"))


@query("SELECT case_id, case when case_id % 4 <> 3 then greatest(ruled_on, filed_on) end AS ruled_on FROM cases", "cases")
def extract_latest_date(spark, sf_dir):
    return derived(spark, sf_dir, "texts").select("case_id", fields.latest_date(F.col("text"), catalogs.SIGNED_ON).alias("ruled_on"))


_PAY = r"(?i)(?:sal[aá]rio(?: contratual)?|remunera[çc][aã]o) de R\$ ([\d.]+,\d{2})"


@query("SELECT case_id, case when reais between 800 and 80000 then reais * 1.0 when reais + 100 between 800 and 80000 then reais + 100.0 end AS salary FROM cases", "cases")
def extract_mode_value(spark, sf_dir):
    return derived(spark, sf_dir, "texts").select("case_id", fields.mode_value(F.col("text"), _PAY, 800, 80_000).alias("salary"))


_INDEX_LABELS = ((r"(?i)ADC\s*58", "ADC 58"), (r"(?is)IPCA-?E.*SELIC|SELIC.*IPCA-?E", "IPCA-E / SELIC"), (r"(?i)\bIPCA-?E\b", "IPCA-E"), (r"(?i)\bSELIC\b", "SELIC"), (r"(?i)\bTR\b", "TR"))


@query("SELECT case_id, case " + " ".join(f"when regexp_matches(text, {q(p)}) then {q(v)}" for p, v in _INDEX_LABELS) + " end AS label FROM texts", "texts")
def extract_priority_label(spark, sf_dir):
    return derived(spark, sf_dir, "texts").select("case_id", fields.priority_label(F.col("text"), _INDEX_LABELS).alias("label"))


LEGAL_FIELDS = (
    ("number", r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})", "high"),
    ("court", r"(\d{1,2}ª Vara do Trabalho de [^,.;\n]{3,50})", "high"),
    ("hired", r"(?i)admitid[oa]\s+em\s+(\d{2}/\d{2}/\d{4})", "medium"),
    ("dismissed", r"(?i)dispensad[oa]\s+em\s+(\d{2}/\d{2}/\d{4})", "medium"),
    ("reason", r"(?i)(sem justa causa|com justa causa|rescisão indireta|pedido de demissão)", "medium"),
    ("notice", r"(?i)aviso prévio indenizado de (\d+)", "medium"),
    ("procedure", r"(?i)rito (ordinário|sumaríssimo)", "high"),
    ("weekly", r"(?i)(\d{2}) horas semanais", "medium"),
    ("filed", r"(?i)distribuída em (\d{2}/\d{2}/\d{4})", "medium"),
    ("judge", r"(?i)ju[íi]z[ao]? do trabalho: (?:dra?\. )?([a-zà-ú]+ [a-zà-ú ]{3,60})", "high"),
    ("claimant_lawyer", r"(?i)advogad[oa] do reclamante: (?:dra?\. )?([a-zà-ú]+ [a-zà-ú ]{3,60})", "high"),
    ("company_lawyer", r"(?i)advogad[oa] da reclamada: (?:dra?\. )?([a-zà-ú]+ [a-zà-ú ]{3,60})", "high"),
    ("job", r"(?i)exercia a função de ([^,.;\n()]{3,40})", "medium"),
    ("contract", r"(?i)contrato (de experiência|por prazo determinado)", "high"),
    ("notice_kind", r"(?i)aviso prévio (indenizado|trabalhado)", "high"),
    ("schedule", r"(?i)jornada (das \d{1,2}[h:]\d{0,2} às \d{1,2}[h:]\d{0,2})", "medium"),
)


@query("SELECT case_id, " + ", ".join(f"nullif(regexp_extract(text, {q(p)}, 1), '') AS {n}" for n, p, _ in LEGAL_FIELDS) + ", case when regexp_matches(text, '(?i)não faz jus à justiça gratuita') then 'false' when regexp_matches(text, '(?i)defiro.*?justiça gratuita') then 'true' end AS free_justice FROM texts", "texts")
def extract_case_fields(spark, sf_dir):
    t = derived(spark, sf_dir, "texts")
    free = fields.priority_label(F.col("text"), ((r"(?iu)não faz jus à justiça gratuita", "false"), (r"(?iu)defiro.*?justiça gratuita", "true")))
    return t.select("case_id", *(fields.field(F.col("text"), p.replace("(?i)", "(?iu)", 1)).alias(n) for n, p, _ in LEGAL_FIELDS), free.alias("free_justice"))


_TIERED = """SELECT case_id, case when case_id % 3 < 2 then number end AS number, case when case_id % 3 < 2 then case when cast(substr(number, 9, 2) as int) = 98 - cast(substr(number, 1, 7) || substr(number, 12, 4) || substr(number, 17, 1) || substr(number, 19, 2) || substr(number, 22, 4) as bigint) % 97 then 'high' else 'medium' end end AS number_tier,
  case case_id % 4 when 0 then ruled_on when 1 then ruled_on when 2 then date '2024-03-12' end AS ruled, case when case_id % 4 < 3 then 'high' end AS ruled_tier,
  ['Rescisão indireta', 'Sem justa causa', 'Com justa causa', 'Pedido de demissão', 'Término de contrato', NULL][cust_id % 6 + 1] AS reason, case when cust_id % 6 < 5 then 'medium' end AS reason_tier,
  ['Experiência', 'Prazo determinado', 'Pejotização reconhecida', 'Autônomo reconhecido', 'CLT', NULL][(case_id + 1) % 6 + 1] AS contract, ['high', 'high', 'medium', 'medium', 'medium', NULL][(case_id + 1) % 6 + 1] AS contract_tier,
  ['33 dias', '45 dias', NULL, NULL, '20 dias', NULL][(case_id + cust_id) % 6 + 1] AS notice, ['medium', 'medium', NULL, NULL, 'medium', NULL][(case_id + cust_id) % 6 + 1] AS notice_tier FROM tiered_texts"""


@query(_TIERED, "tiered_texts")
def extract_tiered(spark, sf_dir):
    """Number, ruling date, reason, contract and notice with their tiers, by order of trust of their sources."""
    t = F.col("text")
    found = {"number": tiered.case_number(t), "ruled": tiered.ruling_date(t), "reason": tiered.by_priority(t, catalogs.DISMISSAL_REASONS), "contract": tiered.by_priority(t, catalogs.CONTRACT_KINDS), "notice": tiered.notice_days(t)}
    rows = derived(spark, sf_dir, "tiered_texts").select("case_id", *(c.alias(n) for n, c in found.items()))
    return rows.select("case_id", *(c for n in found for c in (F.col(f"{n}.value").alias(n), F.col(f"{n}.tier").alias(f"{n}_tier"))))


_INTEREST_LABELS = ((r"(?i)juros pela SELIC", "SELIC"), (r"(?i)juros de 1% ao m", "1% ao mês"), (r"(?i)juros legais", "Juros legais"))


@query("SELECT case_id, case interest when 'juros pela SELIC' then 'SELIC' when 'juros de 1% ao mês' then '1% ao mês' when 'juros legais' then 'Juros legais' end AS label FROM cases", "cases")
def extract_interest(spark, sf_dir):
    """Interest that a ruling grants, by priority of three wordings."""
    return derived(spark, sf_dir, "texts").select("case_id", fields.priority_label(F.col("text"), _INTEREST_LABELS).alias("label"))


@query(r"""SELECT case_id, nullif(regexp_extract(text, '(?i)\b(IPCAE|SELIC|TR|IPCA[_\-]?E|TRD)\b', 1), '') AS idx, nullif(regexp_extract(text, '(?i)(juros\s+de\s+\d[\d,.]*\s*%|SELIC\s*simples)', 1), '') AS interest, nullif(regexp_extract(text, '\b(150|180|200|220)\b', 1), '') AS divisor, """ + f"nullif(concat_ws('|', {', '.join(f"case when regexp_matches(text, {q('(?i)' + p)}) then {q(n)} end" for p, n in catalogs.CANONICAL_ITEMS)}), '') AS items" + """ FROM texts""", "texts")
def extract_settlement(spark, sf_dir):
    """Index, interest, divisor and the items that a text names, in the order of the catalog."""
    t = F.col("text")
    items = F.nullif(F.concat_ws("|", *(F.when(t.rlike(f"(?iu){p}"), n) for p, n in catalogs.CANONICAL_ITEMS)), F.lit(""))
    return derived(spark, sf_dir, "texts").select("case_id", items.alias("items"), fields.field(t, r"(?i)\b(IPCAE|SELIC|TR|IPCA[_\-]?E|TRD)\b").alias("idx"), fields.field(t, r"(?i)(juros\s+de\s+\d[\d,.]*\s*%|SELIC\s*simples)").alias("interest"), fields.field(t, r"\b(150|180|200|220)\b").alias("divisor"))


@query(f"""SELECT case_id, number, {dmy('hired_on')} AS hired, case when case_id % 2 = 0 then 'manual' else reason end AS reason FROM cases""", "cases")
def merge_by_tier(spark, sf_dir):
    """High-tier values overwrite a second source, others only fill its blanks."""
    found = derived(spark, sf_dir, "texts").select("case_id", *(fields.field(F.col("text"), p.replace("(?i)", "(?iu)", 1)).alias(n) for n, p, _ in LEGAL_FIELDS if n in ("number", "hired", "reason")))
    other = derived(spark, sf_dir, "cases").select("case_id", F.lit("?").alias("number"), F.lit(None).cast("string").alias("hired"), F.when(F.col("case_id") % 2 == 0, "manual").alias("reason"))
    return fields.merge_by_tier(found, other, "case_id", ["number", "hired", "reason"], over=["number"])


@query("SELECT case_id, concat_ws(chr(10), 'Número: ' || number, 'Índice: ' || nullif(rate_index, 'n/a'), 'Honorários: ' || nullif(fee, 'null')) AS context FROM cases", "cases")
def field_context(spark, sf_dir):
    line = lambda label, c: F.concat(F.lit(label), text.clean_null(F.col(c)))
    return derived(spark, sf_dir, "cases").select("case_id", F.concat_ws("\n", line("Número: ", "number"), line("Índice: ", "rate_index"), line("Honorários: ", "fee")).alias("context"))
