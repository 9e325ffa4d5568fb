"""Information-theoretic removal of personal data, with DataFrame and SQL functions only.

Patterns find the protected entities (e-mail and IP addresses, card and phone
numbers). How strongly a term near an entity reveals it is estimated from the
whole corpus: with document counts n(t), n(e), n(t, e) of N documents, the
term discloses the share PMI(t; e) / IC(e) of the entity's information, where
PMI = log(N n(t, e) / (n(t) n(e))) and IC = log(N / n(e)). Terms that disclose
REMOVE of it or more are removed next to the entity, those above GENERALISE are
replaced by a general word; a pair needs two different texts as evidence. Near
means within WINDOW code points of the entity; a term is a word of four letters
or more.

Java's patterns get possessive loops and a start that is not inside the run
before it, so their matches are those of the plain patterns but time is linear
in the text and no stack grows. Places of matches are running sums by doubling,
and parts of a text are taken from pieces of fixed length, so that time stays
near linear in the number of matches too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causa.llm.common import cut, unused

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 64  # code points of context on either side of an entity
SUPPORT = 2
REMOVE = 0.95
GENERALISE = 0.8
TERM = r"\p{L}{4,}+"
PIECE = 1024  # code points
FEW_TERMS = 200_000  # hashes of candidate terms that are broadcast at most

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": "contains({0}, '@')", "ip": "{0} rlike '[0-9][.][0-9]'", "card": "{0} rlike '[0-9][0-9 -][0-9 -]'", "phone": "contains({0}, '+')"}
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + (case when i % 2 = 1 then 1 else 2 end) * int(substr(reverse({_DIGITS}), i, 1))
    - (case when i % 2 = 0 and int(substr(reverse({_DIGITS}), i, 1)) > 4 then 9 else 0 end)) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> p rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _named(value: str, name: str, body: str) -> str:
    """SQL: body with a value that is worked out once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(array: str, step: str) -> str:
    """SQL: running sums or maxima of an array: each round combines entries twice as far apart. step: SQL of a and b."""
    far = "r[i - int(shiftleft(1, j))]"
    return f"aggregate(sequence(0, int(log2(size({array}) + 1))), {array}, (r, j) -> transform(r, (x, i) -> if(i >= int(shiftleft(1, j)), {step.format(a='x', b=far)}, x)))"


def matches(text: str, pattern: str) -> str:
    """SQL: spans (s, e, v) of all matches of a pattern, in code points, from the lengths of what lies between and of what matches."""
    p = _quoted(pattern)
    parts = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (a, b) -> struct(length(a) as gap, b as v))"
    spans = "filter(transform(z, (x, i) -> struct(ends[i] - length(x.v) as s, ends[i] as e, x.v as v)), x -> x.v is not null)"
    return _named(parts, "z", _named("transform(z, x -> x.gap + coalesce(length(x.v), 0))", "sizes", _named(_running("sizes", "{a} + {b}"), "ends", spans)))


def _pieces(text: str) -> str:
    """SQL: a text in pieces of PIECE code points."""
    return f"regexp_extract_all({text}, {_quoted(f'(?s).{{1,{PIECE}}}')}, 0)"


def _part(pieces: str, lo: str, hi: str) -> str:
    """SQL: the strings that make up the code points [lo, hi) of a text in pieces."""
    a, b = f"int(({lo}) div {PIECE})", f"int(({hi}) div {PIECE})"
    at = lambda k: f"coalesce(get({pieces}, {k}), '')"
    return f"""if({a} = {b}, array(substr({at(a)}, ({lo}) % {PIECE} + 1, ({hi}) - ({lo}))),
        concat(array(substr({at(a)}, ({lo}) % {PIECE} + 1)), slice({pieces}, {a} + 2, {b} - {a} - 1), array(substr({at(b)}, 1, ({hi}) % {PIECE}))))"""


def _rebuilt(text: str, spans: str, mark: str) -> str:
    """SQL: a text with marks in place of spans, an array of structs with s and e sorted by s. mark: SQL of the span y.x
    and of y.at, the end of all spans before it."""
    pairs = "transform(spans, (x, i) -> struct(x as x, if(i = 0, 0, reach[i - 1]) as at))"
    parts = f"flatten(transform({pairs}, y -> concat(if(y.x.s > y.at, {_part('pieces', 'y.at', 'y.x.s')}, cast(array() as array<string>)), array({mark}))))"
    whole = f"array_join(concat({parts}, {_part('pieces', 'reach[size(reach) - 1]', f'length({text})')}), '')"
    body = _named("transform(spans, x -> x.e)", "ends", _named(_running("ends", "greatest({a}, {b})"), "reach", whole))
    return _named(_pieces(text), "pieces", _named(spans, "spans", body))


def entities(text: str) -> str:
    """SQL: array of (kind, s, e, v) of the valid matches, by kind in order, then by start."""
    parts = [
        f"if({_NEEDS[k].format(text)}, transform(filter({matches(text, PATTERNS[k])}, x -> {_VALID[k]}), x -> struct({n} as kind, x.s as s, x.e as e, x.v as v)), cast(array() as array<struct<kind:int,s:int,e:int,v:string>>))"
        for n, k in enumerate(KINDS[:4])
    ]
    return f"concat({', '.join(parts)})"


def _context(text: str) -> str:
    """SQL: array of (entity, term, s, e) of the terms that stand whole within WINDOW of each entity, outside all entities."""
    w = WINDOW
    sides = (
        (f"greatest(x.s - {w}, 0)", "x.s", f"t.s > 0 or x.s <= {w}", f"greatest(x.s - {w}, 0)"),
        ("x.e", f"least(x.e + {w}, n)", f"t.e < {w} or x.e + {w} >= n", "x.e"),
    )
    found = []
    for lo, hi, whole, base in sides:
        near = _named(f"array_join({_part('masked', lo, hi)}, '')", "near", matches("near", TERM))
        found.append(f"transform(filter({near}, t -> {whole}), t -> struct(lower(t.v) as term, t.s + {base} as s, t.e + {base} as e))")
    entity = "xxhash64(x.kind, if(x.kind = 0, lower(x.v), regexp_replace(x.v, '[^0-9.]', '')))"
    terms = f"flatten(transform(base, x -> transform(concat({', '.join(found)}), t -> struct({entity} as entity, t.term as term, t.s as s, t.e as e))))"
    # entities as signs that are no letters
    blank = "repeat(chr(1), greatest(0, y.x.e - greatest(y.x.s, y.at)))"
    masked = _rebuilt(text, "array_sort(transform(base, x -> struct(x.s as s, x.e as e)))", blank)
    return _named(_named(masked, "m", _pieces("m")), "masked", _named(f"length({text})", "n", terms))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, base, terms): base spans and the removed or generalised terms of every row.

    base: array of (kind, s, e, v), kinds numbered as in KINDS; terms: array of
    (s, e, general). Offsets are code points, ends exclusive. A null text counts
    as empty; repeated rows are counted as documents and each get their spans; a
    null id is a document like any other. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = rows.select("id", "text", F.expr(entities("text")).alias("base"))
    slim = cut(spans.select("id", F.xxhash64("text").alias("text_hash"), "base", F.expr(f"if(size(base) = 0, null, {_context('text')})").alias("near")))

    near = slim.where("size(near) > 0").select("id", "text_hash", F.explode("near").alias("n")).select("id", "text_hash", "n.*")
    n_docs = F.lit(slim.count()).cast("double")
    # documents of a pair and of an entity, summed over texts so that copies meet in partial sums
    per_text = near.select("id", "text_hash", "entity", "term").distinct().groupBy("entity", "term", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    pair = per_text.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    entity = near.select("id", "text_hash", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("w"))
    near_terms = pair.select(F.xxhash64("term").alias("c")).distinct()
    if len(near_terms.limit(FEW_TERMS + 1).take(FEW_TERMS + 1)) <= FEW_TERMS:  # otherwise all words are counted, to the same end
        words = words.join(F.broadcast(near_terms), F.xxhash64("w") == F.col("c"), "left_semi")
    term = words.groupBy(F.xxhash64("w").alias("h")).agg(F.count(F.lit(1)).alias("n_t"))
    known = pair.join(entity, "entity").join(term, F.xxhash64("term") == F.col("h"))
    share = F.log(n_docs * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log((n_docs + 1) / F.col("n_e"))
    shown = known.withColumn("share", share).where(F.col("share") >= GENERALISE).select("entity", "term", (F.col("share") < REMOVE).alias("general"))
    hit = near.join(shown, ["entity", "term"]).groupBy("id", "text_hash").agg(F.collect_set(F.struct("s", "e", "general")).alias("terms"))
    out = slim.join(hit.withColumnsRenamed({"id": "hit_id", "text_hash": "hit_hash"}), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    # a term between two entities may be seen from both: it is removed if either says so
    merged = F.expr("""transform(array_sort(array_distinct(transform(coalesce(terms, array()), t -> struct(t.s as s, t.e as e)))),
        x -> struct(x.s as s, x.e as e, forall(terms, t -> t.s <> x.s or t.general) as general))""")
    return out.select(F.col("id").alias(id_col), "text_hash", "base", merged.alias("terms"))


def span_list(kinds: int = len(KINDS)) -> Column:
    """kind:start:end of a row of find(), comma-joined, by kind as listed, then by start."""
    base = F.expr("transform(base, x -> concat(element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1), ':', x.s, ':', x.e))")
    return F.array_join(base if kinds == 4 else F.concat(base, F.expr("transform(terms, x -> concat('term:', x.s, ':', x.e))")), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned: entities become `[EMAIL]`, `[IP]`, `[CARD]`, `[PHONE]`,
    general terms `[WORD]`, removed terms `[REMOVED]`. Overlapping spans are replaced
    together, by the first one's mark. Null texts stay null; all columns are kept.
    """
    own, digest, spans = (unused(docs, n) for n in ("id", "hash", "spans"))
    found = find(docs, id_col, text_col).where("size(base) > 0").select(F.col(id_col).alias(own), F.col("text_hash").alias(digest), "base", "terms").dropDuplicates([own, digest])
    found = found.select(own, digest, F.expr("""array_sort(concat(
        transform(base, x -> struct(x.s as s, x.e as e, element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]'), x.kind + 1) as mark)),
        transform(terms, x -> struct(x.s as s, x.e as e, if(x.general, '[WORD]', '[REMOVED]') as mark))))""").alias(spans))
    text = F.col(text_col)
    both = docs.join(found, text.isNotNull() & F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text.cast("string")) == F.col(digest)), "left")
    # a span that begins before the ones before it end is replaced with them
    clean = F.expr(_rebuilt(f"`{text_col}`", spans, "if(y.x.s >= y.at, y.x.mark, '')"))
    return both.withColumn(text_col, F.when(F.col(spans).isNotNull(), clean).otherwise(text)).drop(own, digest, spans)
