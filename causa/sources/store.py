"""A keyed table that batches are merged into: the last write of a key wins, old keys are dropped.

Rows lie in bucket folders by a hash of their key, each written under the number
of the version that wrote it:

    <path>/data/version=<V>/bucket=<B>/part-*.parquet
    <path>/versions/<V>.json    {"version", "batch", "cutoff", "buckets": {B: V}}

A batch rewrites only the buckets that its keys fall into and then adds one
version file, made under another name and renamed; whoever reads takes the newest
version file and sees that version whole, before or after, never between. The
file names the last batch merged, so a batch that comes again (a stream repeats
its last batch after a failure) changes nothing. Data written without a version
file is never read, and is overwritten by the next try.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


@dataclass(frozen=True)
class Version:
    version: int = 0
    batch: int = -1
    cutoff: str | None = None
    buckets: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Upsert:
    """How rows are merged: by keys, the greatest `order` wins; `created` is the least `order[0]` of all writes of a key.

    A key whose `created` is more than `keep` (an interval such as "7 days") before the newest order[0] seen is dropped; if
    it is written again later, it is new.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    keep: str | None = None
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row per key of rows that hold created."""
        rest = [c for c in rows.columns if c not in (*self.keys, "created")]
        last = F.max_by(F.struct(*rest), F.struct(*self.order)).alias("l")
        return rows.groupBy(*self.keys).agg(last, F.min("created").alias("created")).select(*self.keys, "l.*", "created")


def _files(spark: SparkSession, path: str):
    """The file system of a path, through Spark's own readers' settings."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def newest(spark: SparkSession, path: str) -> Version:
    """The newest version of a store; an empty one where there is none yet."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/versions")
    if not fs.exists(folder):
        return Version()
    numbers = [int(name[:-5]) for name in (s.getPath().getName() for s in fs.listStatus(folder)) if name.endswith(".json") and name[:-5].isdigit()]
    if not numbers:
        return Version()
    text = "".join(r.value for r in spark.read.text(f"{path}/versions/{max(numbers)}.json").collect())  # one short file
    return Version(**json.loads(text))


def _publish(spark: SparkSession, path: str, v: Version) -> None:
    """Adds the version file by a rename; another writer of the same version is an error, not a loss."""
    fs, at = _files(spark, path)
    made, name = at(f"{path}/versions/.{v.version}.making"), at(f"{path}/versions/{v.version}.json")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(v.__dict__).encode()))
    out.close()
    if fs.exists(name) or not fs.rename(made, name):
        raise RuntimeError(f"version {v.version} of {path} was written by someone else")


def _folders(path: str, buckets: dict[str, int]) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in buckets.items()]


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the newest version, with created. schema: what an empty store gives."""
    v = newest(spark, path)
    if not v.buckets:
        return spark.createDataFrame([], schema or "created timestamp")
    rows = spark.read.parquet(*_folders(path, v.buckets))
    return rows if v.cutoff is None else rows.where(F.col("created") >= F.lit(v.cutoff).cast("timestamp"))


def merge(batch: DataFrame, number: int, path: str, how: Upsert) -> bool:
    """Merge a batch, numbered upwards from 0; False where it had been merged before. Rows with a null in a key are a key of their own."""
    spark = batch.sparkSession
    now = newest(spark, path)
    if number <= now.batch:
        return False
    first = how.order[0]
    rows = batch.withColumns({"created": F.col(first), "_bucket": how.bucket()})
    seen = rows.groupBy("_bucket").agg(F.max(first).cast("string").alias("newest")).collect()  # a row per bucket at most
    cutoff = now.cutoff
    if how.keep and seen:
        end = max(r.newest for r in seen if r.newest is not None) if any(r.newest for r in seen) else None
        if end is not None:
            here = spark.sql(f"SELECT cast(timestamp '{end}' - interval {how.keep} AS string) AS cutoff").first()[0]
            cutoff = max(here, cutoff or here)
    touched = {str(r["_bucket"]) for r in seen}
    before = {b: v for b, v in now.buckets.items() if b in touched}
    if before:
        old = spark.read.parquet(*_folders(path, before))
        if now.cutoff is not None:
            old = old.where(F.col("created") >= F.lit(now.cutoff).cast("timestamp"))
        rows = rows.drop("_bucket").unionByName(old).withColumn("_bucket", how.bucket())
    version = now.version + 1
    merged = how.merged(rows.drop("_bucket"))
    if cutoff is not None:
        merged = merged.where(F.col("created") >= F.lit(cutoff).cast("timestamp"))
    # a bucket is one file: tasks hold whole buckets
    merged.withColumn("bucket", how.bucket()).repartition(how.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    fs, at = _files(spark, path)
    kept = {b for b in touched if fs.exists(at(f"{path}/data/version={version}/bucket={b}"))}  # a bucket can end up empty
    buckets = {b: v for b, v in now.buckets.items() if b not in touched} | {b: version for b in kept}
    _publish(spark, path, Version(version, number, cutoff, buckets))
    return True


def sweep(spark: SparkSession, path: str) -> int:
    """Delete what the newest version doesn't name: old data folders and version files. Returns how many folders went."""
    v, (fs, at) = newest(spark, path), _files(spark, path)
    named, gone = {*_folders(path, v.buckets)}, 0
    data = at(f"{path}/data")
    for one in list(fs.listStatus(data)) if fs.exists(data) else []:
        number = int(one.getPath().getName().partition("=")[2])
        if number > v.version:  # of a merge under way
            continue
        for b in fs.listStatus(one.getPath()):
            name = b.getPath().getName()
            if name.startswith("bucket=") and f"{path}/data/version={number}/{name}" not in named:
                fs.delete(b.getPath(), True)
                gone += 1
    for one in fs.listStatus(at(f"{path}/versions")) if fs.exists(at(f"{path}/versions")) else []:
        name = one.getPath().getName()
        if name.endswith(".json") and int(name[:-5]) < v.version:
            fs.delete(one.getPath(), False)
    return gone


def follow(rows: DataFrame, path: str, how: Upsert, state: str):
    """A started query that merges every batch of a stream; `state` is its checkpoint folder."""
    return rows.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path, how) and None).option("checkpointLocation", state).trigger(availableNow=True).start()
