"""Blocks, contents and anchors of long files against plain walks through their pages."""

from __future__ import annotations

import random
import re

from causa import catalogs
from causa.operators import pages

SCHEMA = "doc_id long, page_no int, text string"
TEXTS = {"e": "PROCURAÇÃO", "o": "VISTOS, etc.", "r": "JULGO PROCEDENTE", "x": "PROCURAÇÃO. DISPOSITIVO", "-": "folha"}


def frame(spark, docs):
    return spark.createDataFrame([(d, n, t) for d, texts in docs.items() for n, t in enumerate(texts, 1)], SCHEMA)


def plain_fallback(kinds, longest=60):
    """The last block with a ruling; pages from 1."""
    found, i = None, 0
    while i < len(kinds):
        if kinds[i] not in "or":
            i += 1
            continue
        end = i
        while end + 1 < len(kinds) and end + 1 - i < longest and kinds[end + 1] != "e":
            end += 1
        if set(kinds[i : end + 1]) & set("rx"):
            found = (i + 1, end + 1)
        i = end + 1
    return found


def test_fallback_starts_again_after_each_block(spark):
    rng = random.Random(7)
    docs = {1: ["r" if n in (1, 90) else "-" for n in range(1, 101)], 2: list("--e-")}
    docs |= {d: rng.choices("eorx-", [1, 2, rng.choice([0, 1, 4]), 1, rng.choice([2, 40, 150])], k=rng.randrange(1, 300)) for d in range(3, 60)}
    got = {r.doc_id: (r.first_page, r.last_page) for r in pages.fallback_block(pages.page_flags(frame(spark, {d: [TEXTS[k] for k in v] for d, v in docs.items()}))).collect()}
    assert got[1] == (90, 100) and 2 not in got
    assert got == {d: b for d, v in docs.items() if (b := plain_fallback(v))}


def plain_contents(texts, reach=8):
    text = "\n".join(texts[:15])
    if "SUMÁRIO" not in text.upper() and "SUMARIO" not in text.upper():
        return {}
    found: dict[str, list[int]] = {}
    for line in (x.strip() for x in text.split("\n")):
        at = re.search(r"\b(?:p[aá]g\.?)?\s*(\d{1,4})\s*$", line, re.IGNORECASE)
        kind = next((k for k, p in catalogs.CONTENTS_KINDS if re.search(p.replace("(?iu)", "(?i)"), line)), None)
        if len(line) >= 5 and at and kind and int(at[1]) >= 1:
            found.setdefault(kind, []).append(int(at[1]))
    order = sorted(found, key=lambda k: found[k][0])
    out = {}
    for k, after in zip(order, [*order[1:], None], strict=False):
        last = min(max(found[k]) + reach, found[after][0] - 1 if after else len(texts), len(texts))
        out[k] = (found[k][0], max(last, found[k][0]))
    return out


def slices(df):
    return {d: {r.kind: (r.first_page, r.last_page) for r in rows} for d, rows in _by_doc(df).items()}


def _by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_contents_reach_from_the_first_entry_to_past_the_last(spark):
    rng = random.Random(3)
    names = ["Petição inicial", "Contestação", "Sentença", "ACÓRDÃO do TRT", "Cálculos de liquidação", "Parecer técnico", "Impugnação aos cálculos", "Ofício", "x"]
    docs = {1: ["Sumário\nSentença  01/02/2020  2\nSentença de embargos Pág. 20\nParecer técnico 60"] + ["folha"] * 69, 2: ["Sentença 4"] * 9, 3: ["folha"] * 15 + ["SUMÁRIO\nSentença 3"] + ["folha"] * 4}
    for d in range(4, 40):
        lines = [f"  {rng.choice(names)}  01/02/2020  {rng.choice(['', 'Pág. ', 'pag', 'PÁG'])} {rng.choice([0, rng.randrange(1, 60), 12345])} " for _ in range(rng.randrange(1, 9))]
        docs[d] = ["capa", "SUMARIO\n" + "\n".join(lines[:4]), "\n".join(lines[4:])] + ["folha"] * rng.randrange(60)
    got = slices(pages.contents(frame(spark, docs)))
    assert got[1] == {"sentence": (2, 28), "opinion": (60, 68)} and 2 not in got and 3 not in got
    assert got == {d: m for d, texts in docs.items() if (m := plain_contents(texts))}


def plain_anchors(texts):
    out = {}
    for kind, start, end in catalogs.ANCHORS:
        hits = lambda p, at: [i for i in at if re.search(p.replace("(?iu)", "(?i)"), texts[i])]
        for first in hits(start, range(len(texts)))[:1]:
            within = range(first + 1, min(first + 80, len(texts)))
            last = min(first + 30, len(texts) - 1) if end is None else next(iter(hits(end, within)), within[-1] if len(within) else first)
            out[kind] = (first + 1, last + 1)
    return out


def test_anchors_of_all_kinds(spark):
    rng = random.Random(9)
    some = ["EXCELENTÍSSIMO SENHOR", "Nestes termos", "DEFESA", "Termos em que, pede deferimento", "RESUMO DO CÁLCULO", "PARECER TÉCNICO", "MANIFESTAÇÃO SOBRE OS CÁLCULOS"]
    docs = {d: [rng.choice(some) if rng.random() < 0.04 else "folha" for _ in range(rng.randrange(1, 200))] for d in range(40)}
    assert slices(pages.anchors(frame(spark, docs))) == {d: m for d, texts in docs.items() if (m := plain_anchors(texts))}


def test_timeline_takes_contents_then_anchors_then_the_block(spark):
    signed = "Assinado eletronicamente por X em 01/02/2024"
    docs = {
        1: ["SUMÁRIO\nSentença 2", "folha", "DEFESA"],
        2: ["SUMÁRIO\nContestação 2", "folha", f"VISTOS, {signed}", f"ANTE O EXPOSTO {signed}", "fim"],
        3: ["DEFESA", "Requer a improcedência", "VISTOS,", "JULGO PROCEDENTE", "PROCURAÇÃO"],
        4: ["folha", "folha"],
        5: ["ACÓRDÃO", "ACORDAM os magistrados. Desembargador"],
    }
    got = sorted((r.doc_id, r.kind, r.origin, r.first_page, r.last_page) for r in pages.timeline(frame(spark, docs)).collect())
    assert got == [
        (1, "sentence", "contents", 2, 3), (2, "defence", "contents", 2, 5), (2, "sentence", "block", 3, 4), (3, "defence", "anchor", 1, 2), (3, "sentence", "block", 3, 4),
        (4, "sentence", "block", 1, 2), (5, "appeal", "block", 1, 2),
    ]


def test_timeline_without_broadcasts(spark):
    """Joins above a union must not count on the union's partitions."""
    import causa.plans.queries  # noqa: F401
    from causa.plans.registry import QUERIES

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        assert QUERIES["timeline"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_shared_texts_are_read_once(spark):
    rows = [(d, n, (None, "", "DISPOSITIVO Assinado eletronicamente por X em 01/02/2024", "PROCURAÇÃO", "VISTOS, etc.")[(d + n) % 5]) for d in range(20) for n in range(1, 9)]
    frame_of = lambda r: spark.createDataFrame(r, "doc_id long, page_no int, text string")
    shared = pages.page_flags(frame_of(rows))
    plan = shared._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "broadcast" in plan  # of five texts the flags are read once, not 160 times
    # texts that differ in every page stay where they are, and have the same flags
    apart = pages.page_flags(frame_of([(d, n, None if t is None else f"{t}\n{d}.{n}") for d, n, t in rows]).unionByName(frame_of([(99, n, f"folha {n}" + "x" * 200_000) for n in range(1, 200)])))
    assert "rlike" in apart._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(repr, shared.collect())) == sorted(map(repr, apart.where("doc_id < 99").collect()))


def by_operators(df):
    """The decision of every document by the operators on tables of flags, each for itself."""
    flags = pages.page_flags(df)
    blocks = [{r.doc_id: (r.first_page, r.last_page) for r in b.collect()} for b in (pages.last_ruling_block(flags), pages.fallback_block(flags), pages.decision_block(flags))]
    best = blocks[0] | blocks[1] | blocks[2]
    within = {}
    for r in flags.collect():
        if best[r.doc_id][0] <= r.page_no <= best[r.doc_id][1]:
            within.setdefault(r.doc_id, []).append(r)
    kind = {d: "appeal" if any(r.appeal for r in rs) and not any(r.motion or r.settlement or r.order for r in rs) else "sentence" for d, rs in within.items()}
    return {d: (kind[d], "block", *b) for d, b in best.items()}


def test_timeline_decides_as_the_operators_on_flags(spark):
    rng = random.Random(11)
    some = [*TEXTS.values(), "folha", "folha", "DESEMBARGADOR", "embargante", "RPV", None]
    dates = ["", *(f" Assinado eletronicamente por X em 0{n}/02/2024" for n in (1, 2, 3))]
    rows = []
    for d in range(120):
        here = rng.choice(dates)
        for n in range(1, rng.choice([2, 9, 200])):
            here = rng.choice(dates) if rng.random() < 0.3 else here
            t = rng.choice(some) if rng.random() < rng.choice([0.1, 0.9]) else "folha"
            if rng.random() < 0.95:  # a page may be missing
                rows.append((d, n, t and t + here))
    df = spark.createDataFrame(rows, SCHEMA)
    found = pages.timeline(df)
    got = {r.doc_id: (r.kind, r.origin, r.first_page, r.last_page) for r in found.where("origin = 'block'").collect()}
    assert got == by_operators(df)
    # equal texts are read once, and a document's pieces follow from one row
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "Window" not in plan and plan.count("Aggregate [doc_id") == 1 and plan.count("Join") == 1
