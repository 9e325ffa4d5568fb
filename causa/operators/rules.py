"""Prioritised, date-bounded rules over cases, compiled to columns.

A case is one row for itself and one for each of its items. All rules are one
array of structs in one projection of these rows, exploded afterwards: a pass
over the cases with no shuffle and no union per rule. Conditions are plain
columns, not lambdas over the items, so that Spark compiles them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUPREME, STATUTE_CASES, GUIDANCE, LAW, CONSISTENCY = 10, 20, 30, 40, 50


_SLOTS = "array<struct<rule_id:string,level:string,messages:array<string>,priority:int>>"


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    basis: str
    priority: int
    outcomes: Sequence[tuple[str, str, str]]  # SQL condition on the case, level, message SQL; the first that holds counts
    since: str | None = None  # of the hiring date
    undated_applies: bool = True
    every: bool = False  # all outcomes that hold count
    #: SQL array of messages for the item i with the index k in the case's array items, level; an alert for each message
    item_outcomes: Sequence[tuple[str, str]] = ()
    #: (name, SQL) of values that conditions read by their name, computed once per case, or per item from i, k and the values before; a case's read its earlier ones
    case_values: Sequence[tuple[str, str]] = ()
    item_values: Sequence[tuple[str, str]] = ()


def _slot(rule: Rule, level: str, messages: str) -> str:
    return f"named_struct('rule_id', '{rule.id}', 'level', '{level}', 'messages', {messages}, 'priority', {rule.priority})"


def _slots(rule: Rule, hired_col: str, of_items: bool) -> list[str]:
    """SQL of the places of a rule in the row of a case or of an item; null where it is silent or doesn't apply."""
    if of_items:
        found = [_slot(rule, level, messages) for messages, level in rule.item_outcomes]
    else:
        made = [f"when {condition} then {_slot(rule, level, f'array({message})')}" for condition, level, message in rule.outcomes]
        found = [f"case {w} end" for w in (made if rule.every else [" ".join(made)] if made else [])]
    if rule.since is None:
        return found
    return [f"if(coalesce({hired_col} >= date '{rule.since}', {str(rule.undated_applies).lower()}), {x}, null)" for x in found]


def apply(cases: DataFrame, rules: Sequence[Rule], id_col: str = "case_id", hired_col: str = "hired_on", carry: Sequence[str] = (), silent: bool = False) -> DataFrame:
    """(id_col, carry, rule_id, level, message, priority), a row per alert; items must stand in the case's order.

    carry: further columns of the case that its alerts keep. silent: every case has one row more, without a rule.
    """
    ranked = sorted(rules, key=lambda r: r.priority)
    named = lambda field: dict(v for r in ranked for v in getattr(r, field))
    with_items = any(r.item_outcomes for r in ranked)
    rows = cases
    for n, e in named("case_values").items():  # a value reads those before it
        rows = rows.withColumn(n, F.expr(e))
    if with_items:  # the case itself is the row 0
        typed = cases.schema["items"].dataType
        rows = rows.select("*", F.posexplode_outer(F.concat(F.array(F.lit(None).cast(typed.elementType)), F.coalesce("items", F.array().cast(typed)))).alias("row_no", "i"))
        rows = rows.withColumn("k", F.col("row_no") - 1)
        for n, e in named("item_values").items():
            rows = rows.withColumn(n, F.expr(e))
    own = [x for r in ranked for x in _slots(r, hired_col, of_items=False)] + (["named_struct('rule_id', string(null), 'level', string(null), 'messages', array(string(null)), 'priority', int(null))"] if silent else [])
    slots = F.expr(f"array({', '.join(own)})") if own else F.array()
    if with_items:
        each = F.expr(f"array({', '.join(x for r in ranked for x in _slots(r, hired_col, of_items=True))})")
        slots = F.when(F.col("row_no") == 0, slots.cast(_SLOTS) if not own else slots).otherwise(each)
    # projected before it is exploded, as a generator's own expressions are not compiled, and exploded with its nulls, so that no filter repeats it
    found = rows.select(id_col, *carry, slots.alias("slots")).select(id_col, *carry, F.explode_outer("slots").alias("s")).where("s is not null")
    return found.select(id_col, *carry, "s.rule_id", "s.level", F.explode("s.messages").alias("message"), "s.priority")


def metadata(spark, rules: Sequence[Rule]) -> DataFrame:
    """The rule catalog as a table; its size is that of the rule list."""
    return spark.createDataFrame([(r.id, r.title, r.basis, r.priority, r.since, len(r.outcomes) + len(r.item_outcomes)) for r in rules], "rule_id string, title string, basis string, priority int, since string, outcomes int")


def checked(meta: DataFrame) -> DataFrame:
    """Adds faults: what is missing or wrong in a rule's entry, comma-separated; empty where nothing is. A rule without `since` always was in force."""
    missing = [(F.coalesce(F.col(c), F.lit("")) == "", n) for c, n in (("rule_id", "id"), ("title", "title"), ("basis", "basis"))]
    undated = F.col("since").isNotNull() & ~(F.col("since").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("since").try_cast("date").isNotNull())
    repeated = (F.col("rule_id") != "") & (F.count(F.lit(1)).over(Window.partitionBy("rule_id")) > 1)
    faults = [*missing, (F.coalesce(F.col("priority"), F.lit(0)) <= 0, "priority"), (undated, "since"), (F.col("outcomes") == 0, "outcomes"), (repeated, "repeated")]
    return meta.withColumn("faults", F.concat_ws(",", *(F.when(c, n) for c, n in faults)))
