"""Queries that run as streams; each ends with what a batch over the same rows gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from causa import catalogs
from causa.functions import similarity, text
from causa.plans import documents, reports
from causa.plans.registry import query
from causa.sources import files, store
from causa.sources.tables import table
from causa.streaming import jobs


@query(documents._LONG)
def stream_extract(spark, sf_dir):
    return jobs.drain(jobs.extract(jobs.landing(spark, f"{sf_dir}/documents.parquet"), catalogs.GENERIC_FIELDS), "extract")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    events = jobs.landing(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.drain(jobs.first_seen(events, ["user_id", "event_type"]), "dedup").select("user_id", "event_type")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_kpis(spark, sf_dir):
    events = jobs.landing(spark, f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = jobs.drain(jobs.windowed_counts(events, "event_type").select(F.col("window.start").alias("hour"), "event_type", "n"), "kpis", "update")
    return jobs.latest(counts, ["hour", "event_type"], ["batch"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def _store(spark, sf_dir, name, rows, how):
    """The store that a stream of the events was merged into."""
    path = files.scratch(spark, name)
    store.follow(rows(jobs.landing(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))), f"{path}/table", how, f"{path}/state").awaitTermination()
    return store.read(spark, f"{path}/table", "user_id long, event_type string, day date, event_id long, value double, ts timestamp, created timestamp")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_status(spark, sf_dir):
    """Last write per key: batches are merged into a keyed store."""
    rows = _store(spark, sf_dir, "status", lambda e: e.select("user_id", "event_type", "event_id", "value", "ts"), store.Upsert(("user_id", "event_type"), ("ts", "event_id")))
    return rows.select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, ts::DATE AS day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, min(ts)::TIMESTAMP AS created FROM events
  GROUP BY ALL HAVING min(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def stream_retained(spark, sf_dir):
    """A job per user, type and day with its last status; those begun more than seven days before the newest event are dropped."""
    how = store.Upsert(("user_id", "event_type", "day"), ("ts", "event_id"), "7 days")
    rows = _store(spark, sf_dir, "retained", lambda e: e.select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", "value", "ts"), how)
    return rows.select("user_id", "event_type", "day", "event_id", "value", F.col("created").cast("timestamp_ntz").alias("created"))


@query(reports._REPLAY)
def stream_kb(spark, sf_dir):
    events = jobs.landing(spark, f"{sf_dir}/events.parquet")
    deltas = events.select(F.col("user_id").alias("tenant"), F.col("event_type").alias("rule_key"), "ts", "event_id", F.when(F.col("value") > 8, 1).otherwise(-1).alias("delta"))
    with jobs.typed_state(spark):
        states = jobs.drain(jobs.rule_lives(deltas), "kb", "update")
    return jobs.latest(states, ["tenant", "rule_key"], ["batch"]).select("tenant", "rule_key", "score", "status", "hits", "punished")


_OVERDUE = """WITH s AS (SELECT user_id, event_id, ts AS started_at FROM events WHERE event_type = 'click'), f AS (SELECT user_id, ts AS finished_at FROM events WHERE event_type <> 'click'),
  w AS (SELECT least((SELECT max(started_at) FROM s), (SELECT max(finished_at) FROM f)) - INTERVAL 10 MINUTE AS passed)
  SELECT user_id, event_id FROM s, w WHERE started_at + INTERVAL 5 MINUTE < passed AND NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = s.user_id AND finished_at BETWEEN started_at AND started_at + INTERVAL 5 MINUTE)"""


@query(_OVERDUE)
def stream_timeouts(spark, sf_dir):
    """Jobs that ran for more than five minutes, known once the watermark has passed their limit."""
    events = jobs.landing(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    starts = events.where("event_type = 'click'").select("user_id", "event_id", F.col("at").alias("started_at"))
    finishes = events.where("event_type <> 'click'").select("user_id", F.col("at").alias("finished_at"))
    return jobs.drain(jobs.overdue(starts, finishes, "user_id"), "overdue").select("user_id", "event_id")


@query()
def section_fuzzy(spark, sf_dir):
    """First line of each document that resembles a synonym; all windows of a batch of lines are scored at once."""
    synonyms = (("terms", "licensed under the terms"), ("notice", "all rights reserved"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", text.norm_text(F.col("line")).alias("line"))
    near = lines.select("doc_id", "line_no", *(similarity.resembles(F.col("line"), s).alias(n) for n, s in synonyms))
    first = near.groupBy("doc_id").agg(*(F.min(F.when(F.col(n), F.col("line_no"))).alias(n) for n, _ in synonyms))
    return first.unpivot("doc_id", [n for n, _ in synonyms], "section", "line_no").where("line_no is not null")
