"""Life of learned rules from a log of hits and punishments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_AT, DELETED_AT = 3, -1


def step(state: Column, delta: Column) -> Column:
    """One event: score moves by delta; a rule becomes active at ACTIVE_AT for good, is deleted at DELETED_AT
    unless active, and a deleted one is born again by a hit."""
    reborn = (state["status"] == "deleted") & (delta > 0)
    frozen = ((state["status"] == "active") & (delta < 0)) | ((state["status"] == "deleted") & (delta < 0))
    score = F.when(reborn, 1).when(frozen, state["score"]).otherwise(state["score"] + delta)
    status = F.when(frozen, state["status"]).when(score >= ACTIVE_AT, "active").when(score <= DELETED_AT, "deleted").otherwise(F.when(reborn, "shadow").otherwise(state["status"]))
    return F.struct(score.cast("int").alias("score"), status.alias("status"))


def _state(score, status: str) -> Column:
    return F.struct(F.lit(score).cast("int").alias("score"), F.lit(status).alias("status"))


#: States that a rule can be in before a stretch of its log: a shadow's scores lie between the limits.
_STARTS = [*((s, "shadow") for s in range(DELETED_AT + 1, ACTIVE_AT)), (DELETED_AT, "deleted")]


def _after(state: Column, stretch: Column) -> Column:
    """State after a stretch: an active rule gains its hits, a deleted one stays where there is none, all else is looked up."""
    at = F.when(state["status"] == "deleted", len(_STARTS) - 1).otherwise(state["score"] - (DELETED_AT + 1))
    grown = F.struct((state["score"] + stretch["gain"]).cast("int").alias("score"), state["status"].alias("status"))
    return F.when(state["status"] == "active", grown).when((state["status"] == "deleted") & (stretch["hits"] == 0), state).otherwise(F.get(stretch["ends"], at))


def replay(events: DataFrame, keys: list[str], order: list[str], stretch: Column | None = None) -> DataFrame:
    """(keys, score, status, hits, punished) after all events of a key, in order. events: keys, order columns and delta.

    stretch: a value that ascends with the order, such as the day. The log of a key is replayed stretch by stretch,
    from each state that a rule can be in, and the stretches' effects are put together afterwards; so a row holds
    the events of one stretch at most, and a hot key is spread over as many tasks as it has stretches.
    """
    rows = events.withColumn("stretch", F.lit(0) if stretch is None else stretch)
    log = F.transform(F.array_sort(F.collect_list(F.struct(*order, "delta"))), lambda e: e["delta"])
    parts = rows.groupBy(*keys, "stretch").agg(
        log.alias("log"), F.count_if(F.col("delta") > 0).alias("hits"), F.count_if(F.col("delta") < 0).alias("punished"), F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("gain")
    )
    ends = F.array(*(F.aggregate("log", _state(*s), step) for s in _STARTS))
    parts = parts.select(*keys, F.struct("stretch", ends.alias("ends"), "hits", "gain").alias("part"), "hits", "punished")
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("hits").cast("int").alias("hits"), F.sum("punished").cast("int").alias("punished"))
    return whole.select(*keys, F.aggregate("parts", _state(0, "shadow"), _after).alias("s"), "hits", "punished").select(*keys, "s.*", "hits", "punished")


STATE = "tenant long, rule_key string, born_round int, born_case long, score long, status string, hits long, punished long"
_STRETCH = 4096


def _ranked(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds each row's place among the rows of its keys, from 1. Places within stretches of `order` are added to the
    rows before each stretch, so no task sorts all rows of a key."""
    at = F.expr(f"{order} div {_STRETCH}")
    parts = rows.withColumn("_at", at)
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select(*keys, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(order))
    return parts.withColumn(name, local).join(shifts, [*keys, "_at"]).withColumn(name, F.col(name) + F.col("_shift")).drop("_at", "_shift")


def _alike(names: DataFrame, known: DataFrame) -> DataFrame:
    """(tenant, name, rule_key, ...known) of distinct names that contain a rule's key or are contained in it."""
    low = F.lower(F.trim("rule_key"))
    return names.select("tenant", "name").distinct().join(known, "tenant").where(F.contains("name", low) | F.contains(low, "name"))


def learning_round(number: int, state: DataFrame, hypotheses: DataFrame, cases: DataFrame, missed: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, sightings) after one round of learning; state holds STATE, sightings (tenant, rule_key, case_id, round).

    1. Hypotheses (tenant, rule_key, case_id): where a rule that isn't deleted has a key that contains the hypothesis' or is
       contained in it, the first born of them gains one; else the first case makes a new rule of score 1, the others gain.
    2. Rules that were shadows before the round are tried on all `cases` (tenant, case_id) in order: one of `missed`
       (tenant, case_id, name) that is alike is a hit, its absence a punishment. A shadow becomes active at ACTIVE_AT on
       the way; DELETED_AT on the way deletes for good, whatever comes after.
    3. `deletes` (tenant, rule_key) are deleted by hand, with a score of -99.

    Repeated rows count once. A rule's way through the cases is found from its hits and their places among the cases: between
    two hits the score only falls, so its lowest and highest points lie just before and at a hit, or at the end.
    """
    live = state.where("status <> 'deleted'")
    wanted = hypotheses.distinct().withColumn("name", F.lower(F.trim("rule_key")))
    first = _alike(wanted, live.select("tenant", "rule_key", "born_round", "born_case")).groupBy("tenant", "name").agg(F.min_by("rule_key", F.struct("born_round", "born_case", "rule_key")).alias("known"))
    found = wanted.join(first, ["tenant", "name"], "left").select("tenant", F.coalesce("known", "rule_key").alias("rule_key"), "case_id")
    gains = found.groupBy("tenant", "rule_key").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_case"))
    new = F.col("status").isNull() | ((F.col("status") == "deleted") & F.col("n").isNotNull())
    n = F.coalesce("n", F.lit(0))
    score = F.when(new, n).otherwise(F.col("score") + n)
    grown = state.join(gains, ["tenant", "rule_key"], "full").select(
        "tenant", "rule_key", F.when(new, number).otherwise(F.col("born_round")).alias("born_round"), F.when(new, F.col("first_case")).otherwise(F.col("born_case")).alias("born_case"), score.alias("score"),
        F.when((F.col("status").isin("active", "deleted")) & ~new, F.col("status")).when(score >= ACTIVE_AT, "active").otherwise("shadow").alias("status"),
        F.when(new, n - 1).otherwise(F.col("hits") + n).alias("hits"), F.when(new, F.lit(0)).otherwise(F.col("punished")).alias("punished"),
    )

    tried = state.where("status = 'shadow'").select("tenant", "rule_key")
    ranked = _ranked(cases.distinct(), ["tenant"], "case_id", "place")
    totals = ranked.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"))
    alike = _alike(missed, tried)
    hits = missed.join(alike, ["tenant", "name"]).select("tenant", "rule_key", "case_id").distinct().join(ranked, ["tenant", "case_id"])
    nth = _ranked(hits, ["tenant", "rule_key"], "case_id", "nth")
    way = nth.groupBy("tenant", "rule_key").agg(F.count(F.lit(1)).alias("c"), F.min(2 * (F.col("nth") - 1) - (F.col("place") - 1)).alias("low"), F.max(2 * F.col("nth") - F.col("place")).alias("high"))
    ways = tried.join(totals, "tenant").join(way, ["tenant", "rule_key"], "left").select("tenant", "rule_key", "total", F.coalesce("c", F.lit(0)).alias("c"), "low", "high").withColumn("end", 2 * F.col("c") - F.col("total"))
    low, high = F.col("score") + F.least("low", "end"), F.col("score") + F.greatest("high", "end")
    by_hand = deletes.distinct().withColumn("gone", F.lit(True))
    judged = grown.join(ways, ["tenant", "rule_key"], "left").join(by_hand, ["tenant", "rule_key"], "left")
    status = F.when(F.col("gone") | (F.col("status") == "deleted") | (low <= DELETED_AT), "deleted").when(high >= ACTIVE_AT, "active").otherwise(F.col("status"))
    after = judged.select(
        "tenant", "rule_key", F.col("born_round").cast("int").alias("born_round"), "born_case", F.when(F.col("gone"), -99).otherwise(F.col("score") + F.coalesce("end", F.lit(0))).cast("long").alias("score"), status.alias("status"),
        (F.col("hits") + F.coalesce("c", F.lit(0))).cast("long").alias("hits"), (F.col("punished") + F.coalesce(F.col("total") - F.col("c"), F.lit(0))).cast("long").alias("punished"),
    )
    seen = found.unionByName(hits.select("tenant", "rule_key", "case_id")).distinct().withColumn("round", F.lit(number))
    return after, seen


def seen_cases(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """state with `seen`: the number of different cases that each rule has met since it was born."""
    born = state.select("tenant", "rule_key", "born_round")
    met = sightings.join(born, ["tenant", "rule_key"]).where(F.col("round") >= F.col("born_round")).select("tenant", "rule_key", "case_id").distinct()
    return state.join(met.groupBy("tenant", "rule_key").agg(F.count(F.lit(1)).alias("seen")), ["tenant", "rule_key"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
