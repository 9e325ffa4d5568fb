"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from test_corpus import PLAIN, luhn, plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from causa.llm import langid, packing
from causa.llm.common import saved

SF = "/root/testdata/sf0.001"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def grams(w, k=5):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def sanitised(text):
    digits = lambda v: sum(c.isdigit() for c in v)
    valid = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 16 <= digits(v) <= 19 and luhn(v), "phone": lambda v: 8 <= digits(v) <= 15}
    spans = sorted((m.start(), m.end(), MARKS[k]) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid[k](m.group()))
    out, at = "", 0
    for s, e, mark in spans:
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:]


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "12345 !!! ???", "en", "s", 13)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    kept = saved(stages["language"](spark, docs.unionByName(extra), SF))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}

    texts = {r.doc_id: r.text for r in kept.collect()}
    prints = {i: plain_fingerprint(t, 5) for i, t in texts.items()}
    groups = plain_components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = saved(stages["near_duplicates"](spark, kept, SF))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))

    items = [grams(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in kept.collect()}
    clean = {i for i, t in before.items() if not any(len(g & grams(words(t))) >= 0.8 * len(g) for g in items)}
    kept = saved(stages["decontamination"](spark, kept, SF))
    assert {r.doc_id for r in kept.collect()} == clean and len(clean) < len(before)

    kept = saved(stages["personal_data"](spark, kept, SF))
    after = {r.doc_id: r for r in kept.collect()}
    assert {i: r.text for i, r in after.items()} == {i: sanitised(before[i]) for i in clean}
    assert all(r.n_chars == len(r.text) for r in after.values()) and kept.columns == docs.columns

    coder, want = Tokenizer.from_file(packing.default_tokenizer()), set()
    for i, r in after.items():
        ids = [*coder.encode(r.text, add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages["packing"](spark, kept, SF).collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "some words of text here", "en", "s", 1), (2, "", "en", "s", 0), (3, "some words of text here", "fr", None, None), (3, "some words of text here", "fr", None, None)]])
def test_odd_rows_pass_through(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        if name == "near_duplicates" and rows:
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 3), (True, 0)]
    assert docs.count() == (2 if rows else 0)


def test_rows_with_one_id_in_different_groups_each_stay(spark):
    said = [" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma")]
    rows = [(5, said[0], "en", "s", 1, "x"), (5, said[1], "en", "s", 1, "x"), (6, said[2], "en", "s", 1, "x"), (7, said[1], "en", "s", 1, "x"), (5, said[1], "en", "t", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, own string")
    kept = corpus_pipeline.one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, said[0]), (5, said[1]), (6, said[2])])


def test_language_stage_acts_on_its_threshold(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    doubtful = spark.createDataFrame([(-1, "你好", None, "s", 2)], docs.schema)
    model = langid.fit(docs.where(~langid.held_out()))
    label, score = langid.identify("你好", model)
    assert label != langid.UNKNOWN and score < 0.9
    both = docs.unionByName(doubtful)
    for least, kept in ((score - 0.01, 1), (score + 0.01, 0)):
        monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", least)
        assert corpus_pipeline.known_language(spark, both, "").where("doc_id = -1").count() == kept
