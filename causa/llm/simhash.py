"""SimHash near-duplicate groups by anchor-point covering.

The anchors are the words of the Hamming code of length 63, a perfect code of
covering radius 1. Two fingerprints that differ in at most two bits have a
point between them at distance one of each at most; the anchor nearest to that
point is within 1 + 1 of both. So each fingerprint goes to every anchor within
radius 2 (32 of them, out of 2^57), and pairs are compared per anchor only. An
anchor can hold no more than 2 * (1 + 63 + 1953) different fingerprints, so no
task ever gathers an unbounded group; equal fingerprints are merged before.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causa.llm.common import cut

MAX_DISTANCE = 2
_SEED = 42
_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed long.

    No word at all gives zero; fewer words than a shingle give one shingle.
    """
    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()  # A-Z and ASCII white space only, as these are bytes
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : min(at + _CHUNK, total) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(_SEED)), np.uint64, len(part) - shingle + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, own, fp): one row per row of docs; own is a hash of the text. Null, empty and blank texts have fingerprint 0."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).withColumn("own", F.xxhash64("body"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["id", "own", "fp"])

    return slim.mapInArrow(run, "id long, own long, fp long").withColumnRenamed("id", id_col)


def _anchors(fp: str) -> F.Column:
    """All code words within two bits of a fingerprint; bit 0 is left out of the code.

    A change of bits i and j moves the syndrome by i xor j, so the code words
    near x come from the pairs with i xor j = syndrome; i = 0 changes one bit only.
    """
    masks = [sum(1 << p for p in range(64) if p >> k & 1) for k in range(6)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    syndrome = " + ".join(f"({1 << k} * (bit_count({fp} & {m}L) % 2))" for k, m in enumerate(signed))
    flips = f"transform(filter(sequence(0, 63), i -> i < (i ^ s)), i -> x ^ if(i = 0, 0L, shiftleft(1L, i)) ^ shiftleft(1L, i ^ s))"
    # one-element transforms name the syndrome and the masked word once
    return F.expr(f"flatten(transform(array(int({syndrome})), s -> flatten(transform(array({fp} & -2L), x -> if(s = 0, array(x), {flips})))))")


def _link(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges from each member of a bucket to the root of its component in the bucket."""
    edges, left = [], np.sort(fps)
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 256):
                near |= (np.bitwise_count((frontier[at : at + 256, None] ^ left[None, :]).view(np.uint64)) <= distance).any(axis=0)
            frontier, left = left[near], left[~near]
            edges += [(int(x), int(root)) for x in frontier]
    return edges


def links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b) edges that connect all different fingerprints within MAX_DISTANCE bits."""
    buckets = (
        distinct_fps.select("fp", F.explode(_anchors("fp")).alias("anchor"))
        .groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    )

    def run(batches):
        for b in batches:
            edges = [e for x in b.column(0) for e in _link(np.array(x.values, np.int64), MAX_DISTANCE)]
            e = np.array(sorted(set(edges)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the (a, b) edges reaches.

    Alternating large-star and small-star rounds: each is two joins on a node.
    Minima are combined before the shuffle and written before they are joined, so
    that AQE can split a node with very many edges. Edges stay linear in the
    nodes; the rounds grow with the logarithm squared.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        state = cut(small.select("e.*").where("a <> b").distinct())
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, own, fp, root, component): component is the smallest id reachable over
    links of at most two differing bits, root a fingerprint that names the group.
    Groups of rows that share an id have the same component but not the same root.

    Null, empty and blank texts share fingerprint 0 and link like any other.
    Repeated rows give repeated rows with one component; a null id takes part as
    a member but never names a component unless all its ids are null. An empty
    table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"))
    first = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(first.select("fp")))
    member = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked"))
    member = cut(member.unionByName(roots.select("root").distinct().join(first, F.col("root") == F.col("fp")).select("fp", "first", "root", F.lit(True).alias("linked"))))
    linked = member.where("linked")
    low = cut(linked.groupBy("root").agg(F.min("first").alias("low")))
    named = linked.join(low, "root").select("fp", "root", F.col("low").alias("name")).distinct()
    # cut, so that AQE can split a hot fingerprint in the last join
    class_of = cut(first.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("first")).alias("component")))
    return fps.join(class_of, "fp").select(F.col("id").alias(id_col), "own", "fp", "root", "component")
