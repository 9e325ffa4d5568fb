"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causa.llm import ann, chat, decontam, langid, negatives, packing, pii, quality, sharding, simhash, spans, suffix, trie
from causa.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = chat.read_back(chat.format_trees(chat.chain(turns.unionByName(own)), unique=True))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(4), 256).alias("base_sha256"), pii.span_list().alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("neighbour").alias("vec_id"), "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.cascade(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(*trie.with_shared_heads(trie.numbered(table(spark, sf_dir, "conversations"))))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_langid, op3_packing, op4_pii, op5_chat, op6_decontamination, op7_sharding, op8_spans, op9_suffix, op10_ann, op11_quality, op12_trie, op13_negatives)
}

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
parts AS (
  SELECT *, length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'))
          + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g')) + 15 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""

_OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
b AS (SELECT doc_id, n, lo, substr(h, (2 * lo + 1)::BIGINT, 598) AS part FROM (SELECT doc_id, h, n, unnest(generate_series(0, n - 100, 200)) AS lo FROM d)),
w AS (SELECT doc_id, lo + j AS i, md5(substr(part, (2 * j + 1)::BIGINT, 200)) AS s FROM (SELECT doc_id, lo, part, unnest(generate_series(0, least(199, n - 100 - lo))) AS j FROM b)),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM f),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT r.doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) AS before, h FROM r JOIN d ON r.doc_id = d.doc_id),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS gone, count(*) AS runs, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT), '' ORDER BY lo) || substr(any_value(h), (2 * max(hi) + 1)::BIGINT) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
n AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS no_letter,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}][ \t]'))) AS items,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS broken FROM s LEFT JOIN c ON s.r = c.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 5 * n_symbols <= n_words AND 10 * n_dup_lines <= 5 * n_lines
  AND 5 * no_letter <= 2 * n_words AND 10 * items <= 9 * n_lines AND 10 * broken <= 5 * n_lines AS kept FROM b
"""

# crc32 of the decimal id: each byte is taken in, then eight steps of one bit
_OP12 = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, c - c % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM t GROUP BY c),
m AS (SELECT s.c, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS m FROM s LEFT JOIN s b ON s.base = b.c),
r AS (SELECT m.c, t.pos AS d, role, text FROM m JOIN t ON t.c = m.base AND t.pos <= m.m UNION ALL SELECT m.c, t.pos - m.h + m.m, role, text FROM m JOIN t ON t.c = m.c AND t.pos > m.h),
p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d)) AS k, length(text) AS chars FROM r UNION ALL SELECT c, 0, '', 0 FROM s),
q AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS n FROM p),
g AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(up) AS up, any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends FROM q GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN kids ON g.d = kids.d AND g.k = kids.k),
below AS (SELECT a.d, a.k, sum((f.kids = 0)::INT) AS leaves, sum((f.n - 1) * f.chars) AS saved FROM f JOIN p a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.k)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN below ON f.d = below.d AND f.k = below.k LEFT JOIN g u ON u.d = f.d - 1 AND u.k = f.up
"""

_OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""

ORACLES = {"op5_chat": _OP5, "op9_suffix": _OP9, "op11_quality": _OP11, "op12_trie": _OP12, "op13_negatives": _OP13}
