"""Rounds of learning against a plain loop over the cases, one after the other."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from causa.operators import learning
from causa.plans import reports


def plain_rounds(rounds):
    """rounds: (hypotheses, cases, missed, deletes) of each; rules are kept in the order in which they are made."""
    rules = defaultdict(list)
    for hypotheses, cases, missed, deletes in rounds:
        snapshot = {t: list(rs) for t, rs in rules.items()}
        shadows = {t: [r for r in rs if r["status"] == "shadow"] for t, rs in snapshot.items()}
        made = defaultdict(dict)
        for tenant, key, case in sorted(set(hypotheses), key=lambda h: (h[2], h[1])):
            like = [r for r in snapshot.get(tenant, []) if r["status"] != "deleted" and (key.lower().strip() in r["key"].lower() or r["key"].lower() in key.lower().strip())]
            rule = like[0] if like else made[tenant].get(key)
            if rule is None:
                rules[tenant] = [r for r in rules[tenant] if r["key"] != key]
                rule = made[tenant][key] = {"key": key, "score": 1, "status": "shadow", "hits": 0, "punished": 0, "seen": {case}}
                rules[tenant].append(rule)
                continue
            up(rule, case)
        names = defaultdict(set)
        for tenant, case, name in missed:
            names[tenant, case].add(name)
        for tenant, case in sorted(set(cases), key=lambda c: c[1]):
            for rule in shadows.get(tenant, []):
                if any(rule["key"].lower().strip() in n or n in rule["key"].lower().strip() for n in names[tenant, case]):
                    up(rule, case)
                else:
                    rule["score"] -= 1
                    rule["punished"] += 1
                    if rule["score"] <= -1:
                        rule["status"] = "deleted"
        for tenant, key in deletes:
            for r in rules[tenant]:
                if r["key"] == key:
                    r["status"], r["score"] = "deleted", -99
    return {(t, r["key"], r["score"], r["status"], r["hits"], r["punished"], len(r["seen"])) for t, rs in rules.items() for r in rs}


def up(rule, case):
    rule["score"] += 1
    rule["hits"] += 1
    rule["seen"].add(case)
    if rule["score"] >= 3 and rule["status"] == "shadow":
        rule["status"] = "active"


def test_rounds_equal_a_plain_loop_on_random_cases(spark, monkeypatch):
    monkeypatch.setattr(learning, "_STRETCH", 5)
    rng = random.Random(6)
    keys = ["Horas Extras", "Horas Extras noturnas", "FGTS", "Férias", "DSR", "Multa"]
    rounds = []
    for n in range(4):
        cases = [(t, c) for t in range(6) for c in range(100 * n, 100 * n + rng.randrange(1, 30))]
        missed = [(t, c, rng.choice(["horas extras", "fgts + multa", "férias", "dsr", "x"])) for t, c in cases for _ in range(rng.randrange(3))]
        some = {(t, rng.choice(keys), c) for t, c in cases if rng.random() < 0.15}
        rounds.append((sorted(some) + sorted(some)[:2], cases, missed, [(rng.randrange(6), rng.choice(keys)) for _ in range(2)]))
    state, seen = spark.createDataFrame([], learning.STATE), None
    for n, (hypotheses, cases, missed, deletes) in enumerate(rounds):
        state, met = learning.learning_round(
            n, state, spark.createDataFrame(hypotheses, "tenant long, rule_key string, case_id long"), spark.createDataFrame(cases, "tenant long, case_id long"),
            spark.createDataFrame(missed, "tenant long, case_id long, name string"), spark.createDataFrame(deletes, "tenant long, rule_key string"),
        )
        state, met = state.checkpoint(), met.checkpoint()
        seen = met if seen is None else seen.unionByName(met)
    got = {(r.tenant, r.rule_key, r.score, r.status, r.hits, r.punished, r.seen) for r in learning.seen_cases(state, seen).collect()}
    assert got == plain_rounds(rounds) and len({r[3] for r in got}) == 3


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_equals_a_plain_loop(spark, size):
    folder = f"/root/testdata/{size}"
    hypotheses, cases, missed = ([tuple(r) for r in i.collect()] for i in reports.learning_inputs(spark, folder))
    rounds = [([(t, k, c) for r, t, k, c in hypotheses if r == n], [(t, c) for r, t, c in cases if r == n], [(t, c, m) for r, t, c, m in missed if r == n], [(t, k) for r, t, k in reports.BY_HAND if r == n]) for n in range(reports.ROUNDS)]
    got = {tuple(r) for r in reports.learning_rounds(spark, folder).collect()}
    assert got == plain_rounds(rounds) and len(got) > 20


def test_missing_items_are_computed_once(spark, monkeypatch):
    calls, plain = [], reports.cases.missing_of
    monkeypatch.setattr(reports.cases, "missing_of", lambda *a: calls.append(1) or plain(*a))
    reports.learning_inputs(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
