"""Conversations from reply trees, with DataFrame and SQL functions only.

Messages hold a parent; pointer doubling (a self-join per doubling) finds every
message's depth, root and summed score along its path in log2(depth) joins.
Leaves are ranked by the mean score of their path, the best ones' ancestors are
gathered by the saved jumps, and each path becomes one formatted conversation.

Template: `<turn:ROLE>TEXT</turn>` and a line feed per turn. Roles and texts are
escaped so that they hold no angle bracket: `\\` is `\\s`, `<` is `\\l`, `>` is
`\\g`. Each backslash of an escaped string is followed by its own letter, so the
way back is three replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causa.llm.common import cut

_OPEN, _CLOSE, _END = "<turn:", ">", "</turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("\\g", ">"), ("\\l", "<"), ("\\s", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (conv, node, parent, role, text, score) of conversations stored as rows by turn.

    Each row answers the one before it. Rows with the same turn are ordered by
    role and text, nulls first, so ties have one order; all rows score alike.
    """
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def one_each(messages: DataFrame) -> DataFrame:
    """One row per (conv, node): of several, the least in order of parent, role, text and score, nulls first."""
    rest = F.struct("parent", "role", "text", F.col("score").cast("double").alias("score"))
    return messages.groupBy("conv", "node").agg(F.min(rest).alias("m")).select("conv", "node", "m.*")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, depth, node) of the `branches` best root-to-leaf paths of each conversation's trees.

    Branches are ranked by mean score along the path, then by length (longer
    first), then by leaf. A parent that is missing makes its child a root. A
    circle of parents is cut at its smallest node, which becomes a root. A node
    must stand in one row only (see one_each).
    """
    found = _best_paths(_keyed(messages), branches)
    return found.withColumn("conv", F.col("conv.id"))


def _keyed(messages: DataFrame) -> DataFrame:
    """The conversation's id within a struct: as a part of a join key a null is equal to a null there."""
    return messages.withColumn("conv", F.struct(F.col("conv").alias("id")))


def _best_paths(messages: DataFrame, branches: int) -> DataFrame:
    base = messages.select("conv", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = base.join(known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(0).alias("depth"))
    # up: the ancestor 2^k above, or null above the root; depth: steps taken so far
    state = cut(start.withColumns({"depth": F.when(F.col("up").isNotNull(), 1).otherwise(0), "low": F.col("node")}))
    most = state.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    jumps = [state.where("up is not null").select("conv", "node", "up")]
    leaves = state.join(state.select("conv", F.col("up").alias("node")).where("node is not null").distinct(), ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"))
    for _ in range(max(0, (most - 1).bit_length())):
        # only messages that haven't reached their root are joined again
        over = state.select("conv", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("steps"), F.col("low").alias("under"))
        moved = state.where("up is not null").join(over, ["conv", "up"]).select("conv", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("steps")).alias("depth"), F.least("low", "under").alias("low"))
        state = cut(state.where("up is null").select("conv", "node", "up", "score", "depth", "low").unionByName(moved))
        jumps.append(state.where("up is not null").select("conv", "node", "up"))
    # whoever hasn't reached a root by now stands on a circle of parents or below one; low is the least node of the circle where up is on it
    turning = state.where("up is not null")
    if not turning.isEmpty():
        ends = turning.select("conv", F.col("up").alias("node")).distinct().join(turning.select("conv", "node", "low"), ["conv", "node"]).where("node = low").select("conv", "node", F.lit(True).alias("ends"))
        parted = messages.join(ends, ["conv", "node"], "left").withColumn("parent", F.when(F.col("ends").isNull(), F.col("parent"))).drop("ends")
        return _best_paths(cut(parted.select("conv", "node", "parent", "score")), branches)
    totals = state.select("conv", "node", "score", "depth")
    rank = Window.partitionBy("conv").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), F.desc("depth"), "leaf")
    ends = leaves.join(totals.withColumnRenamed("node", "leaf"), ["conv", "leaf"]).withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = ends.select("conv", "branch", F.col("leaf").alias("node"))
    for k, jump in enumerate(jumps):
        up = path.join(jump, ["conv", "node"]).select("conv", "branch", F.col("up").alias("node"))
        path = path.unionByName(up)
        if k + 1 < len(jumps):
            path = cut(path)
    return path.join(totals, ["conv", "node"]).select("conv", "branch", "depth", "node")


def format_trees(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """(conv, branch, formatted, loss_spans): one row per chosen path.

    unique: each node is known to stand in one row, as chain() makes them; else see one_each.

    loss_spans are the code points [start, end) of the assistants' texts in
    formatted. A null role or text counts as empty; rows with a null conversation
    are one conversation, with a null id; a conversation without rows gives no row. Messages of one conversation meet in one row, as the format asks.
    """
    messages = messages if unique else cut(one_each(messages))
    messages = _keyed(messages)
    path = _best_paths(messages, branches).join(messages.select("conv", "node", "role", "text"), ["conv", "node"])
    empty = F.lit("")
    turn = F.struct("depth", escape(F.coalesce("role", empty)).alias("role"), escape(F.coalesce("text", empty)).alias("text"), (F.col("role") == "assistant").alias("loss"))
    rows = path.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = len(_OPEN) + len(_CLOSE)
    spans = F.expr(f"""aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),
        (a, t) -> named_struct('at', a.at + {head + len(_END)} + length(t.role) + length(t.text),
            'spans', if(t.loss, concat(a.spans, array(named_struct('start', a.at + {head} + length(t.role), 'end', a.at + {head} + length(t.role) + length(t.text)))), a.spans)),
        a -> a.spans)""")
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(_OPEN), t["role"], F.lit(_CLOSE), t["text"], F.lit(_END))), "")
    return rows.select(F.col("conv.id").alias("conv"), "branch", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role and text) and loss_texts, both read from the formatted text alone."""
    parts = F.filter(F.split("formatted", _END, -1), lambda p: p != "")
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(_OPEN) + 1)), _CLOSE, 1)).alias("role"),
        unescape(F.substring_index(p, _CLOSE, -1)).alias("text"),
    ))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_texts": loss})
