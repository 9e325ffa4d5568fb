"""The prefix trie against a plain one, by every way of peeling."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from causa.llm import queries, trie

SCHEMA = "conv_id long, turn int, role string, text string, conv int, depth string, at long"


def plain(rows, share=True):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if whole[c] == node)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    out = []
    for c in [*range(-3, 40), *range(97, 130), 205, 307]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 12])
        for t in range(n):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long text é𝒳"])))
    deep = [(t, "user" if t % 2 else "assistant", f"t{t // 3}") for t in range(70)]
    for c, n, own in ((500, 70, 70), (501, 70, 70), (502, 66, 40), (503, 61, 20), (504, 33, 33), (505, 17, 17), (506, 16, 16), (507, 70, 18)):
        out += [(c, t, r, x if t < own else f"{c} {x}") for t, r, x in deep[:n]]
    out += [(None, 0, "user", "lost"), (600, 0, "user", "twice"), (600, 0, "user", "twice")]
    return [(*r, 1, "d", 2) for r in out]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("band", "in_task"), [(16, 200_000), (8, 60)])
def test_nodes_equal_plain_ones(spark, band, in_task):
    numbered = trie.numbered(spark.createDataFrame(rows(), SCHEMA).repartition(5))
    assert collected(trie.nodes(*trie.with_shared_heads(numbered), band=band, in_task=in_task)) == plain(rows())


def test_places_run_over_tasks(spark):
    one = [(1, i, "user", str(i), 0, "", 0) for i in range(3000)] + [(2, None, None, None, 0, "", 0)]
    got = trie.numbered(spark.createDataFrame(one, SCHEMA).repartition(7)).orderBy("conv", "pos").collect()
    assert [(r.conv, r.pos) for r in got] == [(1, i + 1) for i in range(3000)] + [(2, 1)]
    assert [r.chars for r in got] == [len(str(i)) for i in range(3000)] + [0]


def test_turnless_conversations_and_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(*trie.with_shared_heads(trie.numbered(none))).collect() == []
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 > 1)  # its base is absent and its turn is among the first h
    lone = [(c, 0, "user", "x", 0, "", 0)]
    got = collected(trie.nodes(*trie.with_shared_heads(trie.numbered(spark.createDataFrame(lone, SCHEMA)))))
    assert got == plain(lone) and got[0][:7] == (c, 0, None, 1, 0, 1, 0)


def test_long_lists_of_ends_are_hashed_in_pieces(spark):
    many = [(c, 0, "user", "same", 0, "", 0) for c in range(100, 9000)]
    whole = trie.numbered(spark.createDataFrame(many, SCHEMA)).withColumnRenamed("pos", "depth")
    got = collected(trie.nodes(whole, whole.select("conv")))
    assert got == plain(many, share=False)


def test_query_runs_on_the_smallest_tables(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert collected(queries.op12_trie(spark, "/root/testdata/sf0.001").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) == want
