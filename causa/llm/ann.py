"""Nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of hash bits (sides of random planes).
A tree is the sorted array of its strings, so all vectors that share a prefix
with a query are one slice of it. A query descends to long prefixes in all trees
and ascends in all of them at once, a bit at a time, until the slices hold
`candidates` entries and `share` entries per vector of the table together; those
slices are scored exactly. Equal vectors are one entry, and their ids are put in
afterwards. Trees are dealt out by tree and leading bits, so a task holds about
`unit_rows` strings however many vectors there are; a query goes to all units
that its slice reaches into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causa.llm.common import cut

TREES = 40
BITS = 24
CANDIDATES = 20_000
SHARE = 0.4
UNIT_ROWS = 1 << 16
SEED = 5


def planes(dim: int, trees: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def hash_strings(x: np.ndarray, trees: int, seed: int = SEED) -> np.ndarray:
    """BITS-bit strings, rows x trees; the first bit is the highest."""
    sides = (x @ planes(x.shape[1], trees, seed) > 0).reshape(len(x), trees, BITS)
    return sides.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def best(query: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k nearest of each query, ties to the smaller id."""
    rows: list[np.ndarray] = []
    cols: list[np.ndarray] = []
    for at in range(0, len(query), 256):
        rough = query[at : at + 256] @ x.T
        floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(rough), -np.inf)
        r, c = np.nonzero(rough >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
        rows.append(r + at)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    score = np.einsum("ij,ij->i", query[r], x[c])  # the same sum for the same vectors, wherever they stand
    by = np.lexsort((ids[c], -score, r))
    r, c, score = r[by], c[by], score[by]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k], score[place < k]


def _grouped(batches, key: str):
    """Tables of the rows of one key each, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), b.num_rows]
        at = 0
        for end in ends:
            part = b.slice(at, end - at)
            if held and held[0].column(key)[0].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, candidates: int = CANDIDATES, share: float = SHARE, unit_rows: int = UNIT_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, neighbour, score): up to k rows per row of vectors that is_query holds for.

    Scores are inner products in double precision. Vectors that are null, zero,
    of another length than most, or hold a null or non-finite number take no
    part, nor does a null id. Rows with a query's id are its own. Equal vectors
    rank by id; only the k + 1 smallest ids of one vector are kept, as no other
    can be among a query's k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fit = F.expr("id is not null and v is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(v, e -> e <> 0)")
    rows = rows.where(fit)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1

    def strings(batches):
        for b in batches:
            v = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            seen: dict[bytes, set[int]] = {}
            keep = np.zeros(len(ids), bool)
            raw = [r.tobytes() for r in x]
            for i in np.argsort(ids, kind="stable"):
                own = seen.setdefault(raw[i], set())
                keep[i] = len(own) <= k and ids[i] not in own
                own.add(ids[i])
            h = hash_strings(x, trees, seed) if len(x) else np.zeros((0, trees), np.int64)
            use = np.flatnonzero(keep | asks)
            same = pa.array([xxhash.xxh3_128_digest(raw[i]) for i in use], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array([raw[i] for i in use], pa.binary()), same, pa.array(asks[use]), pa.array(keep[use]), pa.array(list(h[use]), pa.list_(pa.int64()))], ["id", "raw", "same", "asks", "listed", "keys"])

    base = cut(rows.where(F.size("v") == dim).mapInArrow(strings, "id long, raw binary, same binary, asks boolean, listed boolean, keys array<long>"))
    listed = base.where("listed")
    place = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    members = listed.select("same", "id").distinct().withColumn("place", place).where(F.col("place") <= k + 1).groupBy("same").agg(F.collect_list("id").alias("ids"))
    different = listed.groupBy("same").agg(F.first("raw").alias("raw"), F.first("keys").alias("keys"))
    entries = cut(different.join(members, "same").select(F.monotonically_increasing_id().alias("id"), "ids", "raw", "keys"))
    total = entries.count()
    enough = max(candidates, int(np.ceil(share * total)))
    top = max(0, -(-total // unit_rows) - 1).bit_length()  # leading bits that deal a tree out

    def unit(tree: str, key: str) -> F.Column:
        return F.expr(f"bigint({tree}) * {1 << top}L + shiftright({key}, {BITS - top})")

    slim = entries.select(F.lit(None).cast("long").alias("id"), F.posexplode("keys").alias("tree", "key")).unionByName(base.where("asks").select("id", F.posexplode("keys").alias("tree", "key")))
    slim = slim.select(unit("tree", "key").alias("unit"), "key", "id")
    held = np.zeros((trees, (1 << top) + 1), np.int64)  # strings of each tree before a unit
    for r in slim.where("id is null").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per unit_rows / 2 strings or so
        held[r["unit"] >> top, (r["unit"] & ((1 << top) - 1)) + 1] = r["n"]
    before = spark.sparkContext.broadcast(held.cumsum(axis=1))
    levels = list(range(BITS + 1))

    def sizes_of_slices(batches):
        for t in _grouped(batches, "unit"):
            key, ids, tree = t["key"].to_numpy(), t["id"].combine_chunks(), t["unit"][0].as_py() >> top
            asks = ids.is_valid().to_numpy(zero_copy_only=False)
            q, own, units = key[asks], np.sort(key[~asks]), before.value[tree]
            counts = [units[((q >> (BITS - d)) + 1) << (top - d)] - units[(q >> (BITS - d)) << (top - d)] for d in levels[:top]]
            counts += [np.searchsorted(own, ((q >> (BITS - d)) + 1) << (BITS - d)) - np.searchsorted(own, (q >> (BITS - d)) << (BITS - d)) for d in levels[top:]]
            yield pa.RecordBatch.from_arrays([ids.drop_null(), *(pa.array(c.astype(np.int64)) for c in counts)], ["id", *(f"n{d}" for d in levels)])

    sums = slim.repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(sizes_of_slices, "id long, " + ", ".join(f"n{d} long" for d in levels)).groupBy("id").agg(*(F.sum(f"n{d}").alias(f"n{d}") for d in levels))
    # the longest common prefix length at which all trees together hold enough
    level = F.coalesce(*(F.when(F.col(f"n{d}") >= enough, d) for d in reversed(levels)), F.lit(0))
    depth = sums.select(F.col("id").alias("query"), level.alias("depth"))
    asked = base.where("asks").join(depth, F.col("id") == F.col("query")).select("id", "raw", "depth", F.posexplode("keys").alias("tree", "key"))
    # a prefix shorter than a unit's is met in several units
    begin, wide = f"shiftleft(shiftright(key, {BITS} - depth), {BITS} - depth)", f"shiftleft(1L, greatest({top} - depth, 0))"
    asked = asked.withColumn("first", F.when(F.col("depth") < top, unit("tree", begin)).otherwise(unit("tree", "key")))
    asked = asked.select(F.explode(F.expr(f"sequence(first, first + {wide} - 1)")).alias("unit"), "key", "id", "raw", "depth")
    dealt = entries.select("id", "raw", F.posexplode("keys").alias("tree", "key")).select(unit("tree", "key").alias("unit"), "key", "id", "raw", F.lit(None).cast("int").alias("depth"))
    dealt = dealt.unionByName(asked).repartition("unit").sortWithinPartitions("unit", "key")

    def score(batches):
        for t in _grouped(batches, "unit"):
            key, ids, x = t["key"].to_numpy(), t["id"].to_numpy(), _matrix(t["raw"], dim)
            depths = t["depth"].to_pandas().to_numpy(np.float64)
            own, asks = np.flatnonzero(np.isnan(depths)), np.flatnonzero(~np.isnan(depths))
            if not len(asks) or not len(own):
                continue
            rest = BITS - depths[asks].astype(np.int64)
            begin = (key[asks] >> rest) << rest
            lo, hi = np.searchsorted(key[own], begin), np.searchsorted(key[own], begin + (np.int64(1) << rest))
            by = np.lexsort((hi, lo))
            slices = np.flatnonzero(np.diff(lo[by], prepend=-1) | np.diff(hi[by], prepend=-1))
            out: list[list] = [[], [], []]
            for s, e in zip(slices, [*slices[1:], len(by)], strict=True):
                q, c = asks[by[s:e]], own[lo[by[s]] : hi[by[s]]]
                if len(c):
                    r, col, value = best(x[q], x[c], ids[c], k + 1)
                    for column, v in zip(out, (ids[q][r], ids[c][col], value), strict=True):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "entry", "score"])

    found = dealt.mapInArrow(score, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("score", T.DoubleType())]))
    ids_of = entries.select(F.col("id").alias("entry"), "ids")
    named = found.groupBy("query_id", "entry").agg(F.max("score").alias("score")).join(ids_of, "entry").select("query_id", "score", F.explode("ids").alias("neighbour"))
    once = named.where("neighbour <> query_id").groupBy("query_id", "neighbour").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour", "score")
