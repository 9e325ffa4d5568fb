"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, from the
multivariate hypergeometric law, so that shard sizes are exact (they differ by
one row at most) and the assignment is that of a uniform permutation. Each
partition then permutes its shard labels locally, rows are exchanged, and each
shard is permuted again. A shard is permuted in cells: rows carry random keys,
a cell is a range of keys, and cell sizes are added up to place each cell, so no
task holds more than about `cell_rows` rows however large a shard is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causa.llm.common import cut

SEED = 20
CELL_ROWS = 200_000


def communication_matrix(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """One row per partition: rows that it sends to each shard. Column sums differ by one at most."""
    rng, total = np.random.default_rng(seed), int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng.shuffle(left)
    matrix = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        matrix[i] = _draw(rng, left, int(n))
        left -= matrix[i]
    return matrix


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    total = int(left.sum())
    if n >= total:
        return left.copy()
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros(len(left), np.int64)  # numpy's draw ends at 10^9 rows
    for j, own in enumerate(map(int, left)):
        out[j] = hypergeometric(rng, own, total - own, n)
        n -= int(out[j])
        total -= own
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad ones are good, by inversion.

    Probabilities are products of exact ratios outwards from the mode, to 14
    standard deviations; what lies beyond is less than double precision.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(14 * (n / total * good / total * bad * ((total - n) / max(1, total - 1))) ** 0.5) + 30
    up, down = np.arange(mode, min(high, mode + spread), dtype=np.float64), np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    more = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    less = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([less[::-1], [1.0], more])
    sums = np.cumsum(weights)
    return mode - len(less) + min(int(np.searchsorted(sums, rng.random() * sums[-1], "right")), len(weights) - 1)


def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row; slots run from 0 in each shard.

    size: UTF-8 bytes of the text plus 16. A null text counts as an empty one
    (crc32 0); repeated rows and null ids are placed like any other row; an
    empty table gives an empty result. The driver sees one row count per input
    partition, never rows.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # written once: what follows must see the same rows in the same partitions and order
    slim = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"),
    ))
    counts = {r["part"]: r["n"] for r in slim.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix(np.array([counts[p] for p in parts], np.int64), shards, seed) if parts else np.zeros((0, shards), np.int64)
    rows = docs.sparkSession.sparkContext.broadcast(dict(zip(parts, matrix, strict=True)))
    cells = max(1, -(-sum(counts.values()) // shards // cell_rows))

    def run(batches):
        labels: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column(3).to_numpy(), b.column(4).to_numpy()
            shard = np.empty(len(part), np.int32)
            for p in np.unique(part):
                if p not in labels:
                    own = np.repeat(np.arange(shards, dtype=np.int32), rows.value[int(p)])
                    np.random.default_rng([seed, int(p)]).shuffle(own)
                    labels[int(p)] = own
                shard[part == p] = labels[int(p)][at[part == p]]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), b.column(4), pa.array(shard)], schema=out)

    out = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("shard", pa.int32())])
    sent = slim.withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, size long, text_crc32 long, part int, at long, shard int")
    key = F.xxhash64(F.lit(seed), "part", "at")
    sent = sent.withColumn("key", key).withColumn("cell", (F.shiftrightunsigned("key", 33).cast("long") * cells / F.lit(1 << 31)).cast("int"))
    sizes = sent.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = sent.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "part", "at")) - 1)
    placed = ranked.join(before, ["shard", "cell"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))
