"""Hard negatives from anchor-clustered shared candidate lists.

Anchors are clustered by direction (centroids from a bounded sample). For one
cluster, a candidate x at angle t from the centroid has an inner product of at
most |x| |u| cos(t - radius) with every member u, where radius is the largest
angle of a member. Sorted by that bound, the candidates are one list for the whole
cluster. Every member walks it and ends where the bound falls below the worst
score that it would still keep: nothing further on can count, so the result is
exact whatever the clusters are.

The list lies in slots of at most SLOT_ROWS candidates each, sorted within; members
visit all slots at once, and in two pages: the front of the list first, so that
most members bring a good floor to the rest or end before it. One walk finds
the positives, a second one the negatives in each positive's window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causa.llm.common import saved

CLUSTERS = 32
SAMPLE = 4096
SLOT_ROWS = 1 << 15
FRONT = 1 / 16
_STEP = 512
_MEMBERS = 1024
_LEAST = -(1 << 62)
_MOST = 1 << 62


def quantised(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> tuple[DataFrame, int]:
    """((row, id, label, asks, norm, q), components): every row that takes part, once, with floor(scale * x) of its components.

    Shorter vectors are filled up with zeros. Rows whose scaled norm is 2^31 or more take no part: their scores don't fit a long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity'))").distinct()
    rows = saved(rows)
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)

    def run(batches):
        for b in batches:
            q = np.zeros((b.num_rows, dim))
            v = b.column(2)
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                q[np.arange(dim) < sizes[:, None]] = np.floor(scale * flat)
                norm = np.sqrt((q * q).sum(axis=1))
            use = np.flatnonzero(norm < 1 << 31)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(use)), b.column(1).take(pa.array(use)), b.column(3).take(pa.array(use)), pa.array(norm[use]), pa.array([q[i].tobytes() for i in use], pa.binary())], ["id", "label", "asks", "norm", "q"])

    found = rows.mapInArrow(run, "id long, label long, asks boolean, norm double, q binary")
    return saved(found.select(F.monotonically_increasing_id().alias("row"), "*")), dim


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(x: np.ndarray, clusters: int, rounds: int = 8, seed: int = 2) -> np.ndarray:
    """Unit centroids of the directions of x by a few rounds of k-means; vectors of length zero count for none."""
    x = _unit(x)
    x = x[x.any(axis=1)]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(seed).permutation(len(x))[:clusters]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(sums.any(axis=1)[:, None], _unit(sums), c)
    return c


def _angles(x: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles of rows of x to the centroids c; a row of length zero stands at none."""
    cos = np.divide(x @ c.T, norm[:, None], out=np.ones((len(x), len(c))), where=norm[:, None] > 0)
    return np.arccos(np.clip(cos, -1, 1))


def bounds(x: np.ndarray, norm: np.ndarray, c: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Rows x clusters: no member of length 1 has a larger inner product with the row; widened by far more than rounding takes."""
    apart = np.clip(_angles(x, norm, c) - radius - 1e-6, 0, np.pi)
    return norm[:, None] * (np.cos(apart) + 1e-9)


class _Slot:
    """The candidates of one slot, and the list of one cluster at a time."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        t = pa.Table.from_batches(parts)
        self.row, self.id, self.label, self.norm = (t[c].to_numpy() for c in ("row", "id", "label", "norm"))
        self.x = _matrix(t["q"], dim)
        self.at = None

    def list_of(self, at: int, model: tuple, page: int) -> tuple[np.ndarray, np.ndarray]:
        if self.at != at:
            c, radius, edge = model
            b = bounds(self.x, self.norm, c[at : at + 1], radius[at : at + 1])[:, 0]
            use = np.flatnonzero(b > edge[at] if page == 0 else b <= edge[at])
            self.order = use[np.argsort(-b[use], kind="stable")]
            self.bound, self.at = b[self.order], at
        return self.order, self.bound


def _scores(u: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where none can pass 2^53, else in longs."""
    return (u @ x.T).astype(np.int64) if largest < 1 << 53 else u.astype(np.int64) @ x.astype(np.int64).T


def _walk(slot: _Slot, members: pa.RecordBatch, order: np.ndarray, bound: np.ndarray, dim: int, k: int, same: bool):
    """The best k candidates of each member and want within this slot's part of the list: (member's row, want, id, score)."""
    u, norm, row, label = _matrix(members["q"], dim), members["norm"].to_numpy(), members["row"].to_numpy(), members["label"].to_numpy()
    top_score, floor = (np.array(members[c].to_pylist(), np.int64) for c in ("high", "floor"))
    wants = floor.shape[1]
    best = np.full((len(u), wants, k), _LEAST, np.int64)
    hits: list[tuple] = []
    for s in range(0, len(order), _STEP):
        walking = np.flatnonzero(bound[s] * norm >= floor.min(axis=1))
        if not len(walking):
            break
        o = order[s : s + _STEP]
        score = _scores(u[walking], slot.x[o], float(norm[walking].max() * slot.norm[o].max()))
        able = ((label[walking][:, None] == slot.label[o]) == same) & (row[walking][:, None] != slot.row[o])
        for w in range(wants):
            fits = able & (score >= floor[walking, w][:, None]) & (score <= top_score[walking, w][:, None])
            i, j = np.nonzero(fits)
            if len(i):
                hits.append((walking[i], np.full(len(i), w), o[j], score[i, j]))
                both = np.concatenate([best[walking, w], np.where(fits, score, _LEAST)], axis=1)
                best[walking, w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                floor[walking, w] = np.maximum(floor[walking, w], best[walking, w].min(axis=1))
    if not hits:
        return None
    i, w, c, score = (np.concatenate(h) for h in zip(*hits, strict=True))
    use = score >= floor[i, w]
    i, w, c, score = i[use], w[use], c[use], score[use]
    by = np.lexsort((slot.id[c], -score, w, i))
    i, w, c, score = i[by], w[by], c[by], score[by]
    group = i * wants + w
    first = np.arange(len(group)) - np.searchsorted(group, group) < k
    return [pa.array(row[i[first]]), pa.array(w[first].astype(np.int32)), pa.array(slot.id[c[first]]), pa.array(score[first])]


def _round(rows: DataFrame, members: DataFrame, slots: int, dim: int, model: tuple, page: int, k: int, same: bool) -> DataFrame:
    """(row, want, id, score): what members find on one page of their cluster's list, the best k of each slot.

    members: (cluster, row, label, norm, q, high, floor); high and floor hold a number per want. Candidates aren't
    copied: a member goes to each slot, and slots stream their members past their own candidates.
    """

    def run(batches):
        slot, parts, at = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column("slot").to_numpy(), b.column("cluster").to_numpy()])
            ends = [*(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip([0, *ends], ends, strict=False):
                number, cluster = keys[:, lo]
                if number != at:
                    slot, parts, at = None, [], number
                part = b.slice(lo, hi - lo)
                if cluster < 0:
                    parts.append(part)
                    continue
                if not parts and slot is None:
                    continue
                if slot is None:
                    slot, parts = _Slot(parts, dim), []
                order, bound = slot.list_of(cluster, model, page)
                for s in range(0, part.num_rows, _MEMBERS):
                    out = _walk(slot, part.slice(s, _MEMBERS), order, bound, dim, k, same)
                    if out:
                        yield pa.RecordBatch.from_arrays(out, ["row", "want", "id", "score"])

    here = F.pmod(F.xxhash64("row"), F.lit(slots)).alias("slot")
    none = F.lit(None).cast("array<long>")
    own = rows.select(here, F.lit(-1).alias("cluster"), "row", "id", "label", "norm", "q", none.alias("high"), none.alias("floor"))
    sent = members.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), "cluster", "row", F.lit(None).cast("long").alias("id"), "label", "norm", "q", "high", "floor")
    dealt = own.unionByName(sent).repartition("slot").sortWithinPartitions("slot", "cluster")
    return dealt.mapInArrow(run, "row long, want int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row", "want").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(rows: DataFrame, members: DataFrame, slots: int, dim: int, model: tuple, k: int, same: bool) -> DataFrame:
    """(row, want, id, score, rank) of the k best of every member and want, from both pages."""
    front = saved(_best(_round(rows, members, slots, dim, model, 0, k, same), k))
    # the worst score kept so far is the floor of a want that has all its k
    reached = front.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("reached"))
    left = members.join(reached, "row", "left")
    left = left.withColumn("floor", F.transform("floor", lambda f, w: F.greatest(f, F.coalesce(F.try_element_at("reached", w), f)))).drop("reached")
    edge = F.get(F.array(*(F.lit(float(e)) for e in model[2])), F.col("cluster"))
    left = left.where(edge * F.col("norm") >= F.array_min("floor"))
    return _best(front.drop("rank").unionByName(_round(rows, left, slots, dim, model, 1, k, same)), k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", clusters: int = CLUSTERS, slot_rows: int = SLOT_ROWS, front: float = FRONT, sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that is_anchor holds for.

    A row's score is its inner product with the anchor over floor(scale * x). An anchor's positives are its best rows of
    its own label, the anchor itself left out; for each, the best rows of other labels with low * positive <= 100 *
    negative <= high * positive, larger scores first, ties by smaller id. A positive without such a row gives none.
    Rows with a null id, label or vector, or a null or non-finite component take no part (see quantised() for lengths);
    rows equal in id, label and vector are one; rows that only share an id are rows of their own. Centroids and the cut
    between the pages come from samples of about `sample` rows; they decide what is walked, not what is found.
    """
    spark = vectors.sparkSession
    rows, dim = quantised(vectors, is_anchor, id_col, label_col, vector_col, scale)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).first()
    total, asking = sizes["n"], sizes["asks"]

    def drawn(df: DataFrame, of: int) -> tuple[np.ndarray, np.ndarray]:
        got = df.where(F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(1_000_000_000)) < int(min(1.0, sample / max(of, 1)) * 1e9)).select("norm", "q").toArrow()
        return _matrix(got["q"], dim), got["norm"].to_numpy()

    anchors = rows.where("asks")
    c = centroids(drawn(anchors, asking)[0], clusters)

    def assign(batches):
        for b in batches:
            norm = b["norm"].to_numpy()
            angle = _angles(_matrix(b["q"], dim), norm, c)
            at = np.where(norm > 0, angle.argmin(axis=1), 0) if len(norm) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(np.where(norm > 0, angle.min(axis=1), 0.0))], [*b.schema.names, "cluster", "angle"])

    members = saved(anchors.select("row", "id", "label", "norm", "q").mapInArrow(assign, "row long, id long, label long, norm double, q binary, cluster int, angle double"))
    radius = np.zeros(len(c))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():  # a row per cluster
        radius[r["cluster"]] = r["angle"]
    x, norm = drawn(rows, total)
    edge = np.quantile(bounds(x, norm, c, radius), 1 - front, axis=0) if len(x) else np.zeros(len(c))
    model = (c, radius, edge)
    parallel = 2 * spark.sparkContext.defaultParallelism
    slots = max(1, -(-total // slot_rows), min(parallel, total // 1024))

    long_array = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    first = members.withColumns({"high": long_array(_MOST), "floor": long_array(_LEAST)})
    near = _search(rows, first, slots, dim, model, positives, same=True)
    # exact in longs: scores are below 2^62, so they are split before they are multiplied
    near = near.select("row", (F.col("rank") - 1).alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    part = lambda n, up: F.expr(f"{n} * (positive_score div 100) + " + (f"({n} * (positive_score % 100) + 99) div 100" if up else f"{n} * (positive_score % 100) div 100"))
    near = saved(near.where("positive_score >= 0").withColumns({"least": part(low, True), "most": part(high, False)}).where("least <= most"))
    spans = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("want", F.struct("least", "most")))).alias("spans"))
    span = lambda side, other: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(F.try_element_at("spans", w)[side], F.lit(other).cast("long")))
    second = saved(members.join(spans, "row").withColumns({"high": span("most", _LEAST), "floor": span("least", _MOST)}).drop("spans"))
    far = _search(rows, second, slots, dim, model, negatives, same=False)
    names = members.select("row", F.col("id").alias("anchor_id"))
    return far.join(near.drop("least", "most"), ["row", "want"]).join(names, "row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
