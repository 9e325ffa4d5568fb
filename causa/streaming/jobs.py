"""Streams over landing folders; each runs over what is there and stops, or stays on with another trigger."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from causa import reach_workers
from causa.operators import fields
from causa.operators.learning import ACTIVE_AT, DELETED_AT
from causa.sources import files

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files at a path, with the schema that they have now."""
    reach_workers(spark)
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a pattern, as a stream reads no single file


@contextlib.contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, as typed state asks for; the setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(rows: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read that. With the path of an earlier run it goes on from there."""
    spark = rows.sparkSession
    path = path or files.scratch(spark, name)
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        # a batch that is run again overwrites what it wrote before

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema if mode == "append" else rows.schema.add("batch", IntegerType())).parquet(f"{path}/out")


def extract(docs: DataFrame, catalog: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Fields of new documents, a row per field found."""
    return fields.extract_long(docs, catalog)


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of a key; repeats that come later than the watermark count as new."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key, over the batches of an update stream."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*keys, "l.*")


def overdue(starts: DataFrame, finishes: DataFrame, key: str, limit: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Started jobs (key, started_at, ...) of which no finish (key, finished_at) came within `limit`.

    A stream-stream left outer join: both sides wait in state until the watermark, the newest time seen on the
    slower side less `late`, has passed started_at + limit; then a start without a finish is given out once. Rows that
    come later than the watermark count no more. A null key never meets a finish, so such a job is overdue.
    """
    begun = starts.withWatermark("started_at", late)
    done = finishes.select(F.col(key).alias("_done"), "finished_at").withWatermark("finished_at", late)
    within = f"{key} = _done AND finished_at >= started_at AND finished_at <= started_at + interval {limit}"
    return begun.join(done, F.expr(within), "leftOuter").where("finished_at is null").select(*starts.columns)


LIFE = "score int, status string, hits int, punished int"


class RuleLife(StatefulProcessor):
    """Life of one learned rule as typed state; it may begin from a table of rules and is forgotten when nothing happens to it.

    Gives out (tenant, rule_key, score, status, hits, punished) after each batch that has events of the rule, and a
    row with the status `forgotten` when the watermark passes `forget_ms` after its last event.
    """

    def __init__(self, forget_ms: int | None = None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  the names are Spark's
        r = initialState.iloc[0]
        self.life.update((int(r["score"]), str(r["status"]), int(r["hits"]), int(r["punished"])))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        score, status, hits, punished = self.life.get() if self.life.exists() else (0, "shadow", 0, 0)
        log = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for d in log["delta"].tolist():
            hits, punished = hits + (d > 0), punished + (d < 0)
            if d < 0 and status in ("active", "deleted"):
                continue
            born = status == "deleted"
            score = 1 if born else score + d
            status = "active" if score >= ACTIVE_AT else "deleted" if score <= DELETED_AT else "shadow" if born else status
        self.life.update((int(score), status, int(hits), int(punished)))
        if self.forget_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(log["ts"].max().timestamp() * 1000) + self.forget_ms)
        yield self._row(key, score, status, hits, punished)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        score, _, hits, punished = self.life.get()
        self.life.clear()
        yield self._row(key, score, "forgotten", hits, punished)

    def close(self) -> None:
        pass

    def _row(self, key, *life) -> pd.DataFrame:
        return pd.DataFrame([(*key, *life)], columns=["tenant", "rule_key", "score", "status", "hits", "punished"])


def rule_lives(deltas: DataFrame, known: DataFrame | None = None, forget_ms: int | None = None, late: str = "1 day") -> DataFrame:
    """State of every learned rule after each batch of hits and punishments (tenant, rule_key, ts, event_id, delta).

    known: (tenant, rule_key, score, status, hits, punished) of rules before the first batch, such as the table that
    an earlier stream left. forget_ms: event time without an event after which a rule's state is dropped. The
    stream is to be started under typed_state().
    """
    rows = deltas if forget_ms is None else deltas.withWatermark("ts", late)
    start = None if known is None else known.groupBy("tenant", "rule_key")
    return rows.groupBy("tenant", "rule_key").transformWithStateInPandas(RuleLife(forget_ms), f"tenant long, rule_key string, {LIFE}", "Update", "None" if forget_ms is None else "EventTime", start)
