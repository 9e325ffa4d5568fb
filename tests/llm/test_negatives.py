"""Hard negatives against brute force in whole numbers, on structured, equal, huge and odd vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causa.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, row long, cluster string, floor int"


def plain(rows, step=50, positives=5, keep=3):
    good = {(i, y, tuple(v)) for i, y, v, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, y, v, [math.floor(256 * x) for x in v]) for i, y, v in good]
    out = []
    for i, y, v, q in good:
        if i % step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, r, strict=False)), j, z) for j, z, w, r in good if (j, z, w) != (i, y, v)))
        for p, j, z in [s for s in scored if s[2] == y][:positives]:
            fits = [(n, m) for n, m, x in scored if x != y and 50 * -p <= 100 * -n <= 95 * -p][:keep]
            out += [(i, j, rank + 1, m, -p, -n) for rank, (n, m) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def structured(n=1500, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return [(i, int(rng.integers(3)), (centres[rng.integers(12)] + 0.25 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_structured_vectors_in_many_slots(spark):
    rows = structured()
    want = plain(rows)
    assert len(want) > 300 and mined(spark, rows, clusters=8, slot_rows=200) == want


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(4)]) for i in range(160)]  # many ties and zero scores
    rows += [(50, None, [1.0] * 4), (None, 1, [1.0] * 4), (400, 1, None), (450, 1, [1.0, None, 1.0, 1.0]), (500, 1, [float("nan")] * 4), (550, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(600, 1, []), (650, 1, [0.0] * 4), (700, 2, [1.0]), (751, 0, [1.0, 1.0, 1.0, 1.0, 2.0]), (100, 1, [0.5] * 4), (100, 2, [0.5] * 4), (3, 0, rows[3][2]), rows[0], rows[0]]
    assert mined(spark, rows) == plain(rows)


def test_a_vector_that_many_share(spark):
    rows = structured(400, 6) + [(1000 + i, i % 2, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(300)] + [(2000, 0, [1.0, 0.25, 0.0, 0.0, 0.0, 0.25])]
    assert mined(spark, rows, slot_rows=100) == plain(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.uniform(1e6, 4e6) for _ in range(3)]) for i in range(120)]
    want = plain(rows)
    assert max(r[4] for r in want) > 1 << 53 and mined(spark, rows) == want
    assert mined(spark, [*rows, (121, 0, [1e300, 1e300, 1e300])]) == want


def test_nothing_to_mine(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == [] and mined(spark, [(50, 0, [1.0])]) == []


@pytest.mark.parametrize("page", [0, 1])
def test_bounds_hold_and_walks_end_early(page):
    rows = structured(3000, 12, 5)
    q = np.floor(256 * np.array([r[2] for r in rows]))
    norm = np.linalg.norm(q, axis=1)
    c = negatives.centroids(q[::50], 12)
    angle = negatives._angles(q[::50], norm[::50], c)
    at = angle.argmin(axis=1)
    radius = np.array([angle[at == k, k].max(initial=0) for k in range(len(c))])
    bound = negatives.bounds(q, norm, c, radius)
    assert (q[::50] @ q.T <= norm[::50, None] * bound[:, at].T).all()
    part = pa.RecordBatch.from_pydict({"row": np.arange(len(q)), "id": np.arange(len(q)), "label": [r[1] for r in rows], "norm": norm, "q": [x.tobytes() for x in q]})
    slot = negatives._Slot([part], 12)
    order, bound = slot.list_of(int(at[0]), (c, radius, np.full(len(c), np.median(bound))), page)
    assert (np.diff(bound) <= 0).all() and 0 < len(order) < len(q)
    seen = []
    scores = negatives._scores
    try:
        negatives._scores = lambda u, x, largest: seen.append(len(x)) or scores(u, x, largest)
        member = pa.RecordBatch.from_pydict({"row": [0], "label": [rows[0][1]], "norm": norm[:1], "q": [q[0].tobytes()], "high": [[negatives._MOST]], "floor": [[negatives._LEAST]]})
        negatives._walk(slot, member, order, bound, 12, 5, True)
    finally:
        negatives._scores = scores
    assert page or sum(seen) < len(q)
