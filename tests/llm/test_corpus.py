"""Operators against brute force on small tables, and their behaviour on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causa.llm import ann, chat, decontam, langid, packing, pii, queries, sharding, simhash, spans, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, text_hash string, unit int"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, lang="en", copies=1):
    rows = [(i, t, lang, "s", len(t or ""), "x", "y", "z", 1) for i, t in enumerate(texts)] * copies
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, copies, a repeated row and a null id."""
    long = " ".join(f"word{i % 977} next{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3), (4, long, "en", "s", 1), (5, long, None, "s", 1), (5, long, None, "s", 1), (None, "some text here. And more.", "fr", None, 1), (6, "!!! 123", "de", "s", 1)]
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def plain_fingerprint(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_plain_ones(spark):
    texts = ["", None, "One", "one  two", "A b\tC d", "é Ü x y z", "a b c a b c a b c", " ".join(map(str, range(500)))]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(frame(spark, texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_links_connect_all_near_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        chain = b
        for _ in range(rng.randrange(6)):
            chain ^= sum(1 << i for i in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
            fps.add(chain)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() >= 1 for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {f: roots.get(f, f) for f in signed} == want


def test_anchor_buckets_are_bounded_and_complete(spark):
    fps = [0, 1, 3, 5, -1, 1 << 62, (1 << 62) | 6, -(1 << 63)]
    got = spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", F.explode(simhash._anchors("fp")).alias("a")).groupBy("a").agg(F.collect_set("fp").alias("s")).collect()
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert any({a, b} <= set(r.s) for r in got)


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component) for r in simhash.near_duplicates(odd).collect())
    assert [(g[1], g[2]) for g in got[:-1]] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6)]
    assert got[-1][0] and got[-1][2] is None
    assert simhash.near_duplicates(none).count() == 0


# language


def test_language_is_learned_without_the_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_langid(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in want)
    held = [i for i in want if got[i].held_out]
    assert sum(got[i].lang_pred == want[i] for i in held) >= 0.95 * len(held)
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    model = langid.fit(other.where(~langid.held_out()))
    assert "xx" not in model.labels and all(0 <= r.score <= 1 for r in got.values())


def test_scores_are_calibrated_and_fall_for_short_mixed_and_unknown_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    model = langid.fit(docs.where(~langid.held_out()))
    assert langid.GRID[0] < model.temperature < langid.GRID[-1] and model.short < langid.SHORT[-1]
    rows = docs.where(langid.held_out()).select("text", "lang").collect()
    mean = []
    for length in (4, 12, 10**9):
        found = [(*langid.identify(r.text[:length], model), r.lang) for r in rows]
        score, right = np.array([s for _, s, _ in found]), np.array([p == lang for p, _, lang in found])
        bins = np.clip((score * 10).astype(int), 0, 9)
        error = sum(abs(score[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
        assert error < 0.05 or length == 4
        mean.append(score.mean())
    assert mean[0] < mean[1] < mean[2] and mean[0] < 0.95 < mean[2]
    assert langid.identify("\u4f60\u597d", model)[1] < 0.8
    apart = [next(r.text for r in rows if r.lang == lang and len(r.text) > 200)[:200] for lang in model.labels]
    assert langid.identify(" ".join(apart), model)[1] < min(langid.identify(t, model)[1] for t in apart)


def test_weights_are_sparse_and_temperature_is_positive(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0


def test_language_on_odd_rows(spark, odd, none):
    model = langid.fit(odd)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert len(got) == 8 and {p for i, p in got if i in (1, 2, 3)} == {"und"}
    assert {p for i, p in got if i in (4, 5, None)} <= set(model.labels)
    blank = langid.fit(none)
    assert blank.labels == [] and langid.predict(odd, blank).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, blank).count() == 0


def test_chunks_of_a_long_text_see_every_ngram(spark, monkeypatch):
    text = "abc déf " * 50
    model = langid.fit(frame(spark, [text, "zzz yyy xxx " * 30], "en").withColumn("lang", F.when(F.col("doc_id") == 0, "a").otherwise("b")))
    whole = langid.identify(text, model)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert langid.identify(text, model)[0] == whole[0]


# packing


def sequences(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    return found


def test_packing_holds_every_piece_once_without_gaps(spark, odd, none):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.pack(docs).collect()
        for own in sequences(rows).values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(packing.default_tokenizer())
        want = Counter()
        for d in docs.collect():
            ids = [*coder.encode(d.text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                want[d.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert len(sequences(rows)) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(none).count() == 0


def test_bin_completion_finds_the_optimum_that_best_fit_misses():
    counts = np.zeros(101, np.int64)
    for x in (60, 40, 55, 45, 50, 30, 20, 51, 49):
        counts[x] += 1
    plan = packing.bin_completion(counts, 100)
    assert sum(n for _, n in plan) == 4
    rng = random.Random(2)
    for _ in range(60):
        counts = np.zeros(101, np.int64)
        for _ in range(rng.randint(0, 40)):
            counts[rng.randint(15, 100)] += 1
        plan = packing.bin_completion(counts, 100)
        used = np.zeros(101, np.int64)
        for pattern, n in plan:
            assert sum(x * c for x, c in pattern) <= 100
            for x, c in pattern:
                used[x] += c * n
        assert (used == counts).all() and sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 100))


@pytest.mark.parametrize("text", ["", "it's we'll HELLO", "a\x1cb c", "İstanbul ΣΑΣ", "中文 hello한 12a-b--c...", "é é", "ﬁ Å ß"])
def test_words_are_encoded_as_the_text(text):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    assert packing.token_bytes(text, packing.default_tokenizer()) == np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(v):
    digits = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(text):
    size = lambda v: sum(c.isdigit() for c in v)
    valid = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 16 <= size(v) <= 19 and luhn(v), "phone": lambda v: 8 <= size(v) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid[k](m.group())]


PII_TEXTS = [
    "mail a.b@c.d_e@f.gh or 😀 x@y.z. and @no.body, abc@@x.yz a@b.c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222222",
    "+1 (555) 010-9999 +1-2 +49 30 123456 7 +++44 20 7946 0958", "", None, "é" * 50 + " user@mail.example.com 8.8.8.8", "1" * 3000 + "." + "2" * 3000, ".".join("ab" for _ in range(3000)) + "@" + ".".join("x" for _ in range(3000)),
]


def test_base_spans_match_plain_patterns(spark, odd, none):
    docs = frame(spark, PII_TEXTS)
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.span_list(4).alias("s")).collect()}
    assert got == {i: ",".join(plain_spans(t)) for i, t in enumerate(PII_TEXTS)}
    assert pii.find(odd).count() == 8 and pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_terms_that_reveal_an_entity_go_and_others_stay(spark):
    texts = [f"the name {w} of jane@mail.org wrote about things {i}" for i, w in enumerate(["Quixotico"] * 4)]
    texts += [f"the name of another thing wrote about things {i}" for i in range(40)] + ["the name of wrote about bob@mail.org"]
    docs = frame(spark, texts)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "the name [REMOVED] of [EMAIL] wrote about things 0"
    assert clean[10] == texts[10] and clean[44] == "the name of wrote about [EMAIL]"
    assert pii.sanitise(docs).columns == docs.columns


def test_pii_query_runs_no_python(spark):
    plan = queries.op4_pii(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# chat


def test_turns_survive_the_template(spark, none):
    texts = ["<turn:user>x</turn>\n", "\\s \\l \\\\ <>", "", None, "a\nb", "\\### Assistant: </turn> ok"]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "user", "assistant", None], texts, strict=True))] + [(3, 0, "user", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv: r for r in chat.read_back(chat.format_trees(chat.chain(turns))).collect()}
    for c in (1, 2):
        assert [(t.role, t.text) for t in back[c].turns] == [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert back[c].loss_texts == [texts[2], texts[4]]
    assert back[3].loss_texts == []
    blank = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_trees(chat.chain(blank)).count() == 0


def test_best_branch_of_a_reply_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 4, "assistant", "end", 0.9), (1, 6, 4, "assistant", "worse", 0.2), (2, 9, 77, "user", "orphan", None)]
    tree = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    got = {(r.conv, r.branch): [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(tree, branches=2)).collect()}
    assert got[1, 1] == ["q", "good", "more", "end"] and got[1, 2] == ["q", "good", "more", "worse"] and got[2, 1] == ["orphan"]


def test_long_chain(spark):
    turns = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.read_back(chat.format_trees(chat.chain(turns))).collect()
    assert got[0].loss_texts == [str(i) for i in range(300)]


# decontamination


def test_leaks_are_found_and_clean_rows_are_not(spark, odd, none):
    items = spark.createDataFrame([(1, "What is the capital of the old kingdom? The capital was the city of Arkenfeld."), (2, "Two trains leave at noon and meet at three. How far apart were the stations then."), (3, None), (4, "")], "item_id long, text string")
    texts = ["filler words " * 300 + "what is the capital of the old kingdom -- the capital was the CITY of arkenfeld!" + " more filler" * 300, "the capital of the kingdom was the city", "filler words " * 50, None, "Two trains leave at noon and meet at three. How far apart were the stations then."]
    docs = frame(spark, texts)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(0, 1), (4, 2)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {1, 2, 3}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, slice_bytes=60).collect()} == {(0, 1), (4, 2)}
    assert decontam.contaminated(odd, items).count() == 0 and decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_wand_retrieves_what_full_scoring_does():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for i in range(70)]
    index = decontam.build_index(items)
    for _ in range(50):
        query = {index.terms[w] for w in rng.sample(vocabulary, 25) if w in index.terms}
        full = defaultdict(float)
        for t in query:
            for i, w in index.postings[t]:
                full[i] += w
        want = {i for i, s in full.items() if s >= 0.5}
        got = dict(decontam.wand(index, query, np.arange(index.bound.shape[1]), 0.5))
        assert set(got) == want and all(abs(got[i] - full[i]) < 1e-9 for i in want)


# sharding


def test_shards_are_exact_and_slots_gapless(spark, odd, none):
    for docs, n in ((odd, 8), (spark.read.parquet(f"{SF}/documents.parquet").repartition(7), 200)):
        rows = sharding.shuffle_into_shards(docs, shards=6, cell_rows=5).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert len(rows) == n and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.size, r.text_crc32) for r in sharding.shuffle_into_shards(frame(spark, ["é", None])).collect()} == {(18, zlib.crc32("é".encode())), (16, 0)}
    assert sharding.shuffle_into_shards(none).count() == 0


def test_matrix_has_exact_margins():
    counts = np.array([0, 5, 100, 1, 37])
    m = sharding.communication_matrix(counts, 9)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    counts = np.array([3_000_000_000, 7, 2_500_000_000, 400_000_000])
    m = sharding.communication_matrix(counts, 9)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


# repeated sentences

PASSAGE = "The first of these sentences has some words. The second one follows with a few more of them. Here is a third that goes on a little. A fourth ends the passage with these last words."


def test_later_copies_of_a_passage_go_and_the_first_stays(spark, odd, none):
    texts = [f"Own start number one here. {PASSAGE} Own end one.", f"Another start.\n{PASSAGE}\nAnother end of it.", "Yes. No. Yes. No. Fine.", "Yes. No. Yes. No. Fine.", None]
    got = {r.doc_id: r for r in spans.remove_repeats(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[1].text == "Another start.\nAnother end of it." and got[1].n_spans == 1 and got[1].n_removed_words == len(PASSAGE.split())
    assert got[2].text == got[3].text == texts[2] and got[4].text is None
    kept = spans.remove_repeats(odd).collect()
    assert len(kept) == 8 and spans.remove_repeats(none).count() == 0


def test_sentence_runs_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts):
        cut = spans.sentences(texts[i])
        assert "".join(texts[i][a:b] for a, b in cut) == texts[i]
        for first, last, h in sorted(spans.runs(texts[i], cut), key=lambda r: (r[0], r[1] - r[0])):
            if h in seen:
                gone[i].update(range(first, last + 1))
            seen.add(h)
    got = {r.doc_id: r.n_removed for r in spans.remove_repeats(docs).collect()}
    assert got == {i: len(gone[i]) for i in texts} and any(got.values())


def test_a_passage_without_full_stops_is_found(spark):
    long = " ".join(f"token{i * 7919 % 1000}" for i in range(90))
    got = {r.doc_id: r for r in spans.remove_repeats(frame(spark, ["one two three " + long + " and done", "other words here\n" + long])).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed_words > 50


# suffixes


def plain_repeats(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        dead = np.zeros(len(text), bool)
        for at in range(len(text) - length + 1):
            w = text[at : at + length]
            if w in seen:
                dead[at : at + length] = True
            seen.add(w)
        kept = bytes(b for b, d in zip(text, dead, strict=True) if not d)
        out[i] = (len(text), int(dead.sum()), int((np.diff(dead.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes_match_brute_force(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choices("ab é", k=rng.randint(60, 400))) for _ in range(12)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) + "".join(rng.choices("xyz", k=rng.randint(0, 150))) for _ in range(60)]
    texts += ["a" * 400, "ab" * 200, texts[0], texts[0], "", None, "x" * 99, "x" * 99]
    docs = frame(spark, texts).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert got == plain_repeats({i: (t or "").encode() for i, t in enumerate(texts)})


def test_repeats_on_odd_rows(spark, odd, none):
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == 8 and suffix.remove_repeats(none).count() == 0
    whole = {r.doc_id: r.n_removed == r.n_bytes for r in rows if r.n_bytes > 1000}
    assert whole == {4: False, 5: True}


def test_blocks_and_chunks_elect_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n, np.uint8).tobytes() for n in (0, 50, 100, 5000, 120, 999)]
    want = {tuple(int(c[i]) for c in a) for a in [suffix.anchors(texts)] for i in range(len(a[0]))}
    monkeypatch.setattr(suffix, "_CHUNK", 1)
    assert {tuple(int(c[i]) for c in a) for a in [suffix.anchors(texts)] for i in range(len(a[0]))} == want
    windows = {(t, w) for t, _, _, f, last in want for w in range(f, last + 1)}
    assert windows == {(t, w) for t, x in enumerate(texts) for w in range(len(x) - 99)}


def test_multikey_order_groups_equal_rows():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = suffix.multikey_order(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows) and all((rows[i] == rows[i + 1]) == (group[i] == group[i + 1]) for i in range(499))


# nearest neighbours


def plain_nearest(rows, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            scored = sorted(((-float(v @ w), j) for j, w in ok if j != i))
            out[i] = [j for _, j in scored[:k]]
    return out


def test_forest_reaches_the_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 32))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(7000, None), (7020, [0.0] * 32), (7040, [float("nan")] * 32), (7060, [None] * 32), (7080, [1.0] * 31)] + [(8000 + i, rows[40][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, candidates=6000).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.neighbour, r.score))
    want = plain_nearest([r for r in rows if r[0] != 7080])
    assert set(found) == set(want)
    assert np.mean([len({n for n, _ in found[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    vectors = {i: np.array(v) for i, v in rows if i < 6000 or i >= 8000}
    assert all(abs(float(vectors[q] @ vectors[n]) - s) < 1e-12 for q in want for n, s in found[q])
    assert [n for n, _ in found[40]] == [*range(8000, 8020)]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.neighbour, r.score) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(few.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def recall(spark, rows, **limits):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    found, want = defaultdict(set), plain_nearest(rows)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **limits).collect():
        found[r.query_id].add(r.neighbour)
    return np.mean([len(found[q] & set(want[q])) / 20 for q in want])


def test_queries_ascend_beyond_a_task_and_with_the_table(spark):
    x = np.random.default_rng(4).standard_normal((4000, 32))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    assert recall(spark, rows, candidates=4000, unit_rows=32) >= 0.9
    assert recall(spark, rows, candidates=100, share=1.0, unit_rows=1 << 16) >= 0.9


def test_copies_of_one_vector_do_not_crowd_out_neighbours(spark):
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(32)
    x = np.concatenate([hot + rng.standard_normal((2000, 32)), np.repeat(0.01 * hot[None], 4000, axis=0)])
    rows = [(i if i < 2000 else 20 * i + 1, [float(y) for y in v]) for i, v in enumerate(x)]
    assert recall(spark, rows, candidates=16_000) >= 0.9


@pytest.mark.parametrize("seed", range(12))
def test_passages_of_over_50_words_are_found_across_sentences(spark, seed):
    rng = random.Random(seed)
    said = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    two, many = f"{said(26)}. {said(26)}.", f"{said(14)}. {said(12)}. {said(11)}. {said(14)}"
    docs = [f"{said(9)}. {two} {said(9)}.", f"{said(15)}. {two} {said(20)}.", f"{said(9)} {many} {said(13)}.", f"{said(30)} {many} {said(5)}.", said(30), f"{said(50)}. {said(20)}."]
    cuts = [set(spans.runs(t, spans.sentences(t))) for t in docs]
    hashes = [{h for _, _, h in c} for c in cuts]
    assert hashes[0] & hashes[1] and hashes[2] & hashes[3] and not hashes[1] & hashes[2] and not hashes[4] & hashes[5]
    if seed == 0:
        got = {r.doc_id: r for r in spans.remove_repeats(frame(spark, docs)).collect()}
        assert [got[i].n_removed for i in (0, 2, 4, 5)] == [0] * 4 and got[1].n_removed_words == 52 and got[3].n_removed_words >= spans.REACH


def test_bin_completion_takes_fewer_copies_than_fit():
    counts = np.zeros(101, np.int64)
    for x in (45, 44, 31, 25, 25, 20, 10):
        counts[x] += 1
    assert sum(n for _, n in packing.bin_completion(counts, 100)) == 2


def test_spans_tell_rows_with_one_id_apart(spark):
    other = " ".join(f"Sentence number {i} says {i * i} things here." for i in range(12))
    rows = [(1, f"{PASSAGE} And x here."), (5, f"Some y first. {PASSAGE} Then z."), (5, other), (None, other[:200]), (None, f"{PASSAGE} None."), (5, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in spans.remove_repeats(docs).collect())
    # the row without an id comes first, so its passage and sentences stay
    assert got[None, rows[3][1]] == 1 and got[None, rows[4][1]] == 1
    lost = {(i, t): n for (i, t), n in got.items() if i is not None}
    assert sum(lost.values()) == 4 and {i for i, _ in lost} == {1, 5} and not any(PASSAGE in t for _, t in lost)
    assert [n for (i, t), n in lost.items() if t.endswith("121 things here.")] == [2]


def test_repeated_bytes_of_hot_seeds_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    parts = ["".join(rng.choices("ab é", k=rng.randint(60, 400))) for _ in range(5)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 5))) + "".join(rng.choices("xyz", k=rng.randint(0, 150))) for _ in range(40)]
    monkeypatch.setattr(suffix, "_PART", 7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame(spark, texts).repartition(3), hot=8).collect()}
    assert got == plain_repeats({i: t.encode() for i, t in enumerate(texts)})


def test_repeated_bytes_tell_rows_with_one_id_apart(spark):
    rng = random.Random(10)
    p, x, y, z, own = ("".join(rng.choices("abcdefgh ", k=k)) for k in (210, 120, 90, 130, 699))
    rows = [(1, p + x), (5, y + p + z), (5, own), (None, own[:300]), (None, z + "!"), (5, own)]
    for hot in (1, suffix.HOT):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect())
        assert got == {(1, 330, 0): 1, (5, 430, 340): 1, (5, 699, 300): 2, (None, 300, 0): 1, (None, 131, 0): 1}


def test_bin_completion_reaches_the_optimum_that_best_fit_misses_on_many_small_histograms():
    def optimum(sizes, most):
        """Fewest bins by trying all bins for each piece, longest first."""
        sizes = sorted(sizes, reverse=True)

        def place(k, rooms, limit):
            if k == len(sizes):
                return True
            if -(-(sum(sizes[k:]) - sum(rooms)) // 100) > limit - len(rooms):
                return False
            for j in sorted({r: j for j, r in enumerate(rooms) if r >= sizes[k]}.values()):
                if place(k + 1, rooms[:j] + [rooms[j] - sizes[k]] + rooms[j + 1 :], limit):
                    return True
            return len(rooms) < limit and place(k + 1, [*rooms, 100 - sizes[k]], limit)

        return next(n for n in range(-(-sum(sizes) // 100), most + 1) if n == most or place(0, [], n))

    rng, missed, at = random.Random(12), 0, 0
    while missed < 200 and at < 20_000:
        at += 1
        sizes = [rng.randint(10, 60) for _ in range(rng.randint(6, 11))]
        counts = np.bincount(sizes, minlength=101)
        greedy = sum(n for _, n in packing.best_fit(counts, 100))
        if greedy > -(-sum(sizes) // 100) and (best := optimum(sizes, greedy)) < greedy:
            missed += 1
            assert sum(n for _, n in packing.bin_completion(counts, 100)) == best
    assert missed == 200


def test_shingles_scattered_over_a_document_are_no_leak():
    item = "What did the old keeper of the lamp write on the wall before the storm came in? He wrote the names of nine ships lost near the northern reef that year."
    index = decontam.build_index([(1, item)])
    own = decontam.words(item)
    scattered = " ".join(" ".join(own[i : i + 6]) + " " + " ".join(f"f{i}x{j}" for j in range(90)) for i in range(0, len(own) - 4, 2))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert grams(own) <= grams(decontam.words(scattered))
    assert decontam.search(scattered, index) == []
    mixed = " ".join(reversed(own))
    for text in (item, f"{'x y z ' * 500}{item}{' a b c' * 500}", f"{mixed} {'pad ' * 200} {item}"):
        assert [r[0] for r in decontam.search(text, index)] == [0]


def test_the_index_grows_with_its_items():
    rng = random.Random(5)
    for n in (500, 4000):
        items = [(i, " ".join(f"w{rng.randrange(n * 20)}" for _ in range(rng.randint(10, 60)))) for i in range(n)]
        index = decontam.build_index(items)
        held = index.postings.bytes() + index.bound.bytes() + index.first.nbytes + index.top.nbytes
        assert held < 12 * sum(len(t) for _, t in items)


def test_slices_share_one_set_of_counts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"v{k}" for k in range(400)], k=30)) + ". " + " ".join(rng.choices([f"u{k}" for k in range(400)], k=10)) + ".") for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = frame(spark, [f"pad {t} pad" for _, t in rows])
    whole = {tuple(r)[:2]: r.score for r in decontam.contaminated(docs, items).collect()}
    sliced = {tuple(r)[:2]: r.score for r in decontam.contaminated(docs, items, slice_bytes=3000).collect()}
    assert whole.keys() == sliced.keys() and len(whole) == 60 and all(abs(whole[k] - sliced[k]) < 1e-9 for k in whole)


def plain_terms(texts, window=64):
    """Term spans by text number: the definitions, one text and term after the other."""
    kinds = {k: n for n, k in enumerate(PLAIN)}
    entities, near, words = [], [], []
    for t in texts:
        base = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in plain_spans(t))]
        masked = list(t)
        for _, s, e in base:
            masked[s:e] = "\x01" * (e - s)
        masked, own = "".join(masked), []
        for k, s, e in base:
            name = kinds[k], t[s:e].lower() if k == "email" else re.sub("[^0-9.]", "", t[s:e])
            for lo, hi in ((max(s - window, 0), s), (e, min(e + window, len(t)))):
                for m in re.finditer(r"[^\W\d_]+", masked[lo:hi]):
                    cut_left, cut_right = hi == s and lo > 0 and m.start() == 0, lo == e and hi < len(t) and m.end() == hi - lo
                    if len(m.group()) >= 4 and not cut_left and not cut_right:
                        own.append((name, m.group().lower(), lo + m.start(), lo + m.end()))
        near.append(own)
        entities.append({x[0] for x in own})
        words.append({w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4})
    n, out = len(texts), []
    for own in near:
        hit = {}
        for name, term, s, e in own:
            both = [t for t, x in zip(texts, near, strict=True) if any(y[:2] == (name, term) for y in x)]
            n_e, n_t = sum(name in x for x in entities), sum(term in x for x in words)
            share = np.log(n * len(both) / (n_t * n_e)) / np.log((n + 1) / n_e)
            if len(set(both)) >= 2 and share >= pii.GENERALISE:
                hit[s, e] = hit.get((s, e), True) and bool(share < pii.REMOVE)
        out.append(sorted((*k, v) for k, v in hit.items()))
    return out


def test_terms_match_a_plain_version(spark):
    rng = random.Random(7)
    common = ["river", "stone", "letter", "garden", "of", "the", "window"]
    people = [(f"Name{chr(97 + i)}o".replace("0", ""), f"p{i}@mail{i}.org", f"+49 30 12345{i:03d}") for i in range(12)]
    texts = []
    for _ in range(160):
        name, mail, phone = rng.choice(people)
        near = [rng.choice([name, name, rng.choice(common), "é" + name.lower()]) for _ in range(2)]
        texts.append(" ".join([*rng.choices(common, k=rng.randint(0, 14)), near[0], rng.choice([mail, mail.upper(), phone]), near[1], *rng.choices(common, k=rng.randint(0, 14)), rng.choice([mail, phone, ""])]))
    texts += [" ".join(rng.choices(common, k=20)) for _ in range(60)]
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.find(frame(spark, texts)).collect()}
    want = plain_terms(texts)
    assert got == dict(enumerate(want)) and sum(map(bool, want)) > 20


def test_personal_data_in_very_long_texts_takes_time_in_proportion(spark):
    numbers = ", ".join(str(100 + i % 900) for i in range(400_000))
    people = ", ".join(f"word user{i}@mail.org, 4111 1111 1111 1111" for i in range(5000))
    began = time.time()
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, [numbers, people])).collect()}
    assert time.time() - began < 60
    assert clean[0] == numbers and clean[1] == ", ".join(["word [EMAIL], [CARD]"] * 5000)


def test_letters_of_all_planes_are_letters():
    model = langid.Model(["a", "b"], np.zeros((langid.PLACES, 2), np.float32), np.zeros(2), 1.0)
    assert langid.identify(chr(0x30001), model)[0] != langid.UNKNOWN and langid.identify("\U0001f600 12", model)[0] == langid.UNKNOWN


def test_training_matches_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        at = np.append(np.sort(rng.choice(50, 6, replace=False)), langid.PLACES)
        rows.append((at, np.append(rng.random(6), 1.0), int(rng.integers(3))))
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.02

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = {(i, c): weight(i, c) for i in at for c in range(3)}
            logits = [sum(v * w[i, c] for i, v in zip(at, x, strict=True)) for c in range(3)]
            p = np.exp(logits) / np.exp(logits).sum()
            for i, v in zip(at, x, strict=True):
                for c in range(3):
                    g = v * (p[c] - (c == y))
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha * w[i, c]
                    n[i, c] += g * g
    got = langid.ftrl(rows, 3, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert all(abs(got[i, c] - weight(i, c)) < 1e-9 for i in [*range(50), langid.PLACES] for c in range(3)) and not got[50:-1].any()


def test_document_frequencies_and_temperature_match_plain_ones(spark):
    texts = ["abc abd", "Abc", "", "xyz é", "abc abd"]
    df, total = langid.document_frequencies(frame(spark, texts).select("text"))
    want = Counter(p for t in texts for p in set(langid._places(t).tolist()))
    assert total == 5 and {i: int(n) for i, n in enumerate(df) if n} == want
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    logits = 6 * rng.standard_normal((400, 3)) + 4 * np.eye(3)[y]
    loss = lambda t: -np.mean([row[k] / t - np.log(np.exp(row / t).sum()) for row, k in zip(logits, y, strict=True)])
    best = min(np.arange(0.5, 15, 0.01), key=loss)
    got, _ = langid.temperature(logits, y, np.full(len(y), 10**12))  # so long that length makes no difference
    assert abs(got / best - 1) < 0.03


def test_large_draws_follow_the_hypergeometric_law():
    from math import comb

    for good, bad, n in ((7, 12, 6), (30, 5, 20), (3, 400, 50), (40, 40, 79)):
        rng = np.random.default_rng(good)
        drawn = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(6000))
        law = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(drawn) <= set(law)
        likely = {k: p for k, p in law.items() if 6000 * p >= 5}
        chi = sum((drawn[k] - 6000 * p) ** 2 / (6000 * p) for k, p in likely.items())
        assert chi < len(likely) + 5 * (2 * len(likely)) ** 0.5 + 5
    rng, (good, bad, n) = np.random.default_rng(0), (3_000_000_000, 5_000_000_000, 2_000_000_000)
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(200)])
    mean, spread = n * good / (good + bad), (n * good / (good + bad) * bad / (good + bad) * (1 - n / (good + bad))) ** 0.5
    assert abs(x.mean() - mean) < 5 * spread / 200**0.5 and 0.8 < x.std() / spread < 1.2


def test_matrices_follow_the_law_of_a_uniform_shuffle():
    from math import comb

    counts, seen = np.array([4, 3, 2]), Counter()
    for seed in range(6000):
        m = sharding.communication_matrix(counts, 3, seed)
        seen[int(m[0, 0]), int(m[0, 1])] += 1
    law = {(a, b): comb(3, a) * comb(3, b) * comb(3, 4 - a - b) / comb(9, 4) for a in range(4) for b in range(4) if 0 <= 4 - a - b <= 3}
    assert sum((seen[k] - 6000 * p) ** 2 / (6000 * p) for k, p in law.items()) < 40 and set(seen) <= set(law)


def test_circles_of_parents_and_repeated_nodes(spark):
    rows = [(1, 1, 2, "user", "a", 0.5), (1, 2, 1, "assistant", "b", 0.5), (1, 3, 2, "user", "c", 0.5), (2, 1, 1, "user", "self", 0.1), (3, 1, None, "user", "q", 0.1), (3, 2, 1, "assistant", "yes", 0.2), (3, 2, 1, "assistant", "yes", 0.2), (3, 2, 1, "assistant", "no", 0.9)]
    tree = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    got = {r.conv: [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(tree)).collect()}
    assert got == {1: ["a", "b", "c"], 2: ["self"], 3: ["q", "no"]}


def test_conversations_without_an_id_and_with_long_texts_are_kept(spark):
    long = "<é\\turn>" * 125_000  # a megabyte
    rows = [(None, 0, "user", "a", "x", 1, 2.0), (None, 1, "assistant", long, "x", 1, 2.0), (5, 0, "assistant", "b", "x", 1, 2.0), (5, None, None, None, "x", 1, 2.0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string, node int, score double")
    got = {r.conv: (r.turns, r.loss_texts) for r in chat.read_back(chat.format_trees(chat.chain(turns), unique=True)).collect()}
    assert got == {None: ([("user", "a"), ("assistant", long)], [long]), 5: ([("", ""), ("assistant", "b")], ["b"])}
    # trees of the null conversation: branches, a missing parent and a circle
    tree = [(None, 1, None, 1.0), (None, 2, 1, 5.0), (None, 3, 1, 9.0), (None, 4, 99, 0.0), (None, 7, 8, 1.0), (None, 8, 7, 1.0), (6, 1, None, 1.0)]
    messages = spark.createDataFrame([(c, n, p, "user", f"m{n}", s) for c, n, p, s in tree], "conv long, node long, parent long, role string, text string, score double")
    paths = {(r.conv, r.branch, r.depth): r.node for r in chat.best_paths(messages, 9).collect()}
    assert paths == {(None, 1, 0): 1, (None, 1, 1): 3, (None, 2, 0): 1, (None, 2, 1): 2, (None, 3, 0): 7, (None, 3, 1): 8, (None, 4, 0): 4, (6, 1, 0): 1}
