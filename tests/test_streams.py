"""Streams over several batches and restarts, and the keyed store that batches are merged into."""

from __future__ import annotations

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from causa.operators import learning
from causa.sources import store
from causa.streaming import jobs

DAY = datetime(2024, 5, 1, 10)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_overdue_jobs_over_batches(spark, folder):
    schema = "job string, kind string, at timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        log = spark.readStream.schema(schema).parquet(f"{folder}/in")
        starts = log.where("kind = 'start'").select("job", F.col("at").alias("started_at"))
        finishes = log.where("kind = 'end'").select("job", F.col("at").alias("finished_at"))
        # the same folder again: the stream goes on from its checkpoint
        return sorted((r.job or "?") for r in jobs.drain(jobs.overdue(starts, finishes, "job"), "jobs", path=f"{folder}/run").collect())

    assert arrive([("a", "start", at(0)), ("a", "end", at(3)), ("b", "start", at(0)), (None, "start", at(1)), ("late", "start", at(2)), ("x", "end", at(4))]) == []
    # c's end comes a batch after its start; late's end comes after its limit
    assert arrive([("c", "start", at(9)), ("late", "end", at(8)), ("exact", "start", at(5)), ("exact", "end", at(10))]) == []
    assert arrive([("c", "end", at(12)), ("d", "start", at(40)), ("x", "end", at(41))]) == ["?", "b", "late"]
    # b's end is later than the watermark; d may still end
    assert arrive([("b", "end", at(2)), ("e", "start", at(43)), ("x", "end", at(44))]) == ["?", "b", "late"]
    assert arrive([("f", "start", at(90)), ("x", "end", at(90))]) == ["?", "b", "d", "e", "late"]


def deltas(seed, n, first):
    rng = random.Random(seed)
    return [(rng.randrange(3), rng.choice("ab"), at(10 * (first + i)), first + i, rng.choice([1, 1, -1])) for i in range(n)]


DELTAS = "tenant long, rule_key string, ts timestamp, event_id long, delta int"
LIFE = ["tenant", "rule_key", "score", "status", "hits", "punished"]


def lives(spark, folder, rows, run, **more):
    spark.createDataFrame(rows, DELTAS).coalesce(1).write.mode("append").parquet(f"{folder}/{run}-in")
    log = spark.readStream.schema(DELTAS).parquet(f"{folder}/{run}-in")
    with jobs.typed_state(spark):
        states = jobs.drain(jobs.rule_lives(log, **more), "kb", "update", path=f"{folder}/{run}")
    return jobs.latest(states, ["tenant", "rule_key"], ["batch"]).select(*LIFE)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_rule_lives_go_on_after_a_restart_and_from_a_table(spark, folder):
    one, two = deltas(1, 60, 0), deltas(2, 60, 60)
    whole = learning.replay(spark.createDataFrame(one + two, DELTAS), ["tenant", "rule_key"], ["ts", "event_id"]).select(*LIFE)
    first = lives(spark, folder, one, "run")
    assert as_set(first) == as_set(learning.replay(spark.createDataFrame(one, DELTAS), ["tenant", "rule_key"], ["ts", "event_id"]).select(*LIFE))
    known = spark.createDataFrame(first.collect(), first.schema)
    assert as_set(lives(spark, folder, two, "run")) == as_set(whole)
    assert as_set(lives(spark, folder, two, "fresh", known=known)) == as_set(whole)


def test_rules_without_events_are_forgotten(spark, folder):
    more = {"forget_ms": 3_600_000, "late": "1 minute"}
    assert as_set(lives(spark, folder, [(1, "a", at(0), 1, 1), (1, "b", at(0), 2, 1), (1, "b", at(50), 3, 1)], "run", **more)) == {(1, "a", 1, "shadow", 1, 0), (1, "b", 2, "shadow", 2, 0)}
    # an hour after its last event a goes; b has had one since
    assert as_set(lives(spark, folder, [(2, "c", at(70), 4, 1)], "run", **more)) == {(1, "a", 1, "forgotten", 1, 0), (1, "b", 2, "shadow", 2, 0), (2, "c", 1, "shadow", 1, 0)}
    # a new event finds no state; the timer of b was set anew by its second event
    assert (1, "a", 1, "shadow", 1, 0) in as_set(lives(spark, folder, [(1, "a", at(80), 5, 1)], "run", **more))


WRITES = "key long, part string, value int, ts timestamp, n long"
HOW = store.Upsert(("key", "part"), ("ts", "n"), buckets=4)


def rows_of(spark, path):
    return {(r.key, r.part): (r.value, r.ts, r.created) for r in store.read(spark, path).collect()}


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), WRITES)


def test_store_merges_each_batch_once(spark, folder):
    assert store.read(spark, folder).count() == 0
    assert store.merge(batch(spark, (1, "x", 10, at(5), 1), (1, "x", 11, at(5), 2), (2, "x", 20, at(1), 3), (None, None, 7, at(1), 4)), 0, folder, HOW)
    want = {(1, "x"): (11, at(5), at(5)), (2, "x"): (20, at(1), at(1)), (None, None): (7, at(1), at(1))}
    assert rows_of(spark, folder) == want
    again = batch(spark, (1, "x", 99, at(9), 9))
    assert not store.merge(again, 0, folder, HOW) and rows_of(spark, folder) == want
    # an older write doesn't win, but moves the time of creation
    assert store.merge(batch(spark, (1, "x", 0, at(2), 5), (2, "x", 21, at(3), 6)), 1, folder, HOW)
    assert rows_of(spark, folder) == {(1, "x"): (11, at(5), at(2)), (2, "x"): (21, at(3), at(1)), (None, None): (7, at(1), at(1))}


def test_store_rewrites_touched_buckets_only_and_readers_see_one_version(spark, folder):
    store.merge(batch(spark, *((k, "x", k, at(0), k) for k in range(40))), 0, folder, HOW)
    before = store.newest(spark, folder)
    assert len(before.buckets) == 4
    open_before = store.read(spark, folder)
    store.merge(batch(spark, (3, "x", 300, at(1), 50)), 1, folder, HOW)
    after = store.newest(spark, folder)
    assert sum(after.buckets[b] != before.buckets[b] for b in before.buckets) == 1
    assert open_before.where("key = 3").first().value == 3 and rows_of(spark, folder)[(3, "x")][0] == 300 and len(rows_of(spark, folder)) == 40
    # data of a merge that failed before its version file is never read, and doesn't stand in the way
    spark.range(3).write.parquet(f"{folder}/data/version=3/bucket=0")
    assert len(rows_of(spark, folder)) == 40
    store.merge(batch(spark, (3, "x", 301, at(2), 51)), 2, folder, HOW)
    assert rows_of(spark, folder)[(3, "x")][0] == 301 and len(rows_of(spark, folder)) == 40
    assert store.sweep(spark, folder) == 2 and len(rows_of(spark, folder)) == 40 and store.newest(spark, folder).version == 3


def test_store_drops_old_keys_in_all_buckets(spark, folder):
    how = store.Upsert(("key", "part"), ("ts", "n"), "7 days", buckets=4)
    day = 24 * 60
    store.merge(batch(spark, *((k, "x", k, at(k * day), k) for k in range(6))), 0, folder, how)
    assert len(rows_of(spark, folder)) == 6
    store.merge(batch(spark, (50, "x", 1, at(9 * day), 60)), 1, folder, how)
    assert {k for k, _ in rows_of(spark, folder)} == {2, 3, 4, 5, 50}
    # a write of a dropped key makes it new; a batch of old rows only leaves nothing behind
    store.merge(batch(spark, (0, "x", 5, at(8 * day), 61), (1, "x", 5, at(0), 62)), 2, folder, how)
    assert {k for k, _ in rows_of(spark, folder)} == {0, 2, 3, 4, 5, 50} and rows_of(spark, folder)[(0, "x")][2] == at(8 * day)


def test_two_writers_of_one_version_do_not_lose_each_other(spark, folder):
    store.merge(batch(spark, (1, "x", 1, at(0), 1)), 0, folder, HOW)
    with pytest.raises(RuntimeError, match="someone else"):
        store._publish(spark, folder, store.Version(1, 0, None, {}))
    assert len(rows_of(spark, folder)) == 1


def test_stream_into_the_store_survives_a_restart(spark, folder):
    def arrive(*rows):
        batch(spark, *rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        store.follow(spark.readStream.schema(WRITES).parquet(f"{folder}/in"), f"{folder}/table", HOW, f"{folder}/state").awaitTermination()
        return {k: v[0] for k, v in rows_of(spark, f"{folder}/table").items()}

    assert arrive((1, "x", 1, at(0), 1), (2, "x", 2, at(0), 2)) == {(1, "x"): 1, (2, "x"): 2}
    assert arrive((1, "x", 5, at(1), 3), (3, "x", 3, at(0), 4)) == {(1, "x"): 5, (2, "x"): 2, (3, "x"): 3}
    assert store.newest(spark, f"{folder}/table").batch == 1
