"""Prefix trie of conversations by truncation peeling.

A depth-d node is a distinct sequence of the first d turns of some conversation.
A node's key is the exclusive or of one 128-bit hash per turn, each taken with the
turn's place, so stripping a node's last turn is one more exclusive or. Peeling
starts with the longest conversations: the nodes of a depth are what ended there
and what came up from one deeper, regrouped by key; members, children, leaves and
saved tokens are added up on the way, so each node is found and summed once.

Whole copies are one class from the start. Turns are kept in bands of BAND turns:
a node carries the turns of its band only, and takes the next band from its
smallest member's. Where all conversations below a node at a band's end have few
turns together (`in_task`), one task peels them; so a few very long
conversations don't cost a job per depth. The rest is peeled by a job per depth.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causa.llm.common import saved

BAND = 16
IN_TASK = 200_000
_CHUNK = 12  # ids of 2^12 make one piece of a node's list of ends
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv long, n_convs long, n_children long, n_leaves long, saved long"
_NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, a, b, chars) per row: its place in its conversation from 1, two hashes of role and text, the text's code points.

    Rows go by turn, nulls first, then role and text; a null role or text is empty; rows without a conversation
    take no part. Rows are sorted across tasks and counted per task, so a long conversation needn't fit into one.
    """
    empty = F.lit("")
    by = ["conv", "turn", "role", "text"]
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    )
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number holds the task above the 33rd bit and counts up along its sorted rows
    rows = saved(rows.select("conv", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("chars")))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return saved(rows.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "chars"))


def with_shared_heads(rows: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first h turns of c - c % group, then come its own after its first h.

    h is crc32 of the decimal c modulo `most`. Where c - c % group has fewer turns all are taken, none where it is absent.
    """
    sizes = saved(rows.groupBy("conv").agg(F.max("pos").alias("n")))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = sizes.select("conv", h, (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = sizes.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = saved(convs.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))
    heads = rows.where((F.col("conv") % group == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), "pos", "a", "b", "chars")
    shared = convs.where("m > 0").join(heads, "base").where("pos <= m").select("conv", F.col("pos").alias("depth"), "a", "b", "chars")
    own = rows.join(convs.select("conv", "h", "m"), "conv").where("pos > h").select("conv", F.expr("pos - h + m").alias("depth"), "a", "b", "chars")
    return shared.unionByName(own), convs.select("conv")


def _peel(base: int):
    """Peels all conversations below one node of depth base, the deepest turns first; also a row of depth base with what they add to that node."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        paths: dict[int, list] = {}
        size = {}
        for conv, members, zs in group.sort_values(["conv", "band"])[["conv", "members", "zs"]].itertuples(index=False):
            paths.setdefault(conv, []).extend((z["z1"], z["z2"], z["chars"]) for z in zs)
            size[conv] = members
        start = (int(key[0]), int(key[1]))
        ended: dict[int, list] = {}
        for conv, path in paths.items():
            k = start
            for z in path:
                k = (k[0] ^ z[0], k[1] ^ z[1])
            ended.setdefault(base + len(path), []).append((k, conv))
        out, alive = [], {}
        for depth in range(max(ended, default=base), base, -1):
            for k, conv in ended.get(depth, ()):
                _add(alive, k, conv, size[conv], 0, 0, 0)
            up: dict = {}
            for k, (conv, n, kids, leaves, spared) in alive.items():
                z = paths[conv][depth - base - 1]
                parent = (k[0] ^ z[0], k[1] ^ z[1])
                leaves, spared = leaves if kids else 1, spared + (n - 1) * z[2]
                out.append((*k, *parent, depth, conv, n, kids, leaves, spared))
                _add(up, parent, conv, n, 1, leaves, spared)
            alive = up
        out += [(*k, 0, 0, base, *v) for k, v in alive.items()]
        return pd.DataFrame(out, columns=_NODE_COLUMNS)

    return run


def _add(level: dict, key: tuple[int, int], conv: int, n: int, kids: int, leaves: int, spared: int) -> None:
    at = level.setdefault(key, [conv, 0, 0, 0, 0])
    at[0] = min(at[0], conv)
    for i, v in enumerate((n, kids, leaves, spared), 1):
        at[i] += v


def _hashes_of_lists(batches):
    """(k1, k2, ends): SHA-256 of the pieces of each key, which follow each other; only the state of one hash is held."""
    key, state = None, None
    for b in batches:
        done: list[tuple] = []
        for k1, k2, piece in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "piece")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield _ends(done)
    if key is not None:
        yield _ends([(*key, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def nodes(turns: DataFrame, convs: DataFrame, band: int = BAND, in_task: int = IN_TASK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    turns: (conv, depth from 1 without gaps, a, b, chars) as numbered() gives them; convs: every conv once, turnless
    ones too, which are members of the root and end there. No conversation gives no node, not even the root.
    Turns are told apart by 128 bits of hashes. The list behind ends_sha256 is hashed in one pass over pieces of up to
    4096 ids: one task per node, as SHA-256 asks, but with a piece in memory only.
    """
    spark = turns.sparkSession
    turn = F.struct("depth", F.xxhash64("depth", "a", "b").alias("z1"), F.xxhash64("b", "a", "depth").alias("z2"), "chars").alias("z")
    rows = turns.select("conv", F.expr(f"(depth - 1) div {band}").alias("band"), turn)
    rows = rows.groupBy("conv", "band").agg(F.bit_xor("z.z1").alias("x1"), F.bit_xor("z.z2").alias("x2"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("z")).alias("zs"))
    bands = saved(rows)
    whole = bands.groupBy("conv").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    whole = saved(convs.join(whole, "conv", "left").select("conv", *(F.coalesce(c, zero).alias(c) for c in ("k1", "k2", "n"))))
    classes = whole.groupBy("k1", "k2", "n").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members"))
    last = bands.select("conv", "band", "zs")
    classes = saved(classes.join(last, (classes.conv == last.conv) & (last.band == F.expr(f"(n - 1) div {band}")), "left").select(classes.conv, "k1", "k2", "n", "members", F.when(F.col("n") > 0, F.col("zs")).alias("zs")))
    deepest = classes.agg(F.max("n")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    found, tops, ending, top = [], {}, [classes.where(F.col("n") <= band)], min(deepest, band)
    rest, at = classes.where(F.col("n") > band).drop("zs"), 1
    if deepest > band:
        running = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
        starts = bands.join(classes.where(F.col("n") > band).select("conv"), "conv", "left_semi").select("conv", "band", *(F.bit_xor(x).over(running).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))))
        starts = saved(starts.where("band > 0"))
    while top == at * band and deepest > top:
        base = at * band
        below = saved(rest.where(F.col("n") > base).join(starts.where(F.col("band") == at).drop("band"), "conv"))
        sizes = below.groupBy("s1", "s2").agg(F.sum(F.col("n") - base).alias("turns"))
        few = below.join(sizes.where(F.col("turns") <= in_task).select("s1", "s2"), ["s1", "s2"], "left_semi")
        paths = few.join(bands.where(F.col("band") >= at).select("conv", "band", "zs"), "conv").select("s1", "s2", "conv", "members", "band", "zs")
        peeled = saved(paths.groupBy("s1", "s2").applyInPandas(_peel(base), _NODE))
        found.append(peeled.where(F.col("depth") > base))
        tops[base] = peeled.where(F.col("depth") == base)
        rest = saved(below.join(sizes.where(F.col("turns") > in_task).select("s1", "s2"), ["s1", "s2"], "left_semi").drop("s1", "s2"))
        most = rest.agg(F.max("n")).first()[0]
        if most is None:
            break
        # these are peeled by depth down to here: those that end within the next band with their turns, deeper ones at the next cut
        here = rest.where(F.col("n") <= base + band).select("conv").join(classes, "conv")
        ending.append(here)
        top, at = min(most, base + band), at + 1

    ended = ending[0]
    for e in ending[1:]:
        ended = ended.unionByName(e)
    ended = ended if len(ending) == 1 else saved(ended)
    adds = ["k1", "k2", "conv", "n_convs", "kids", "leaves", "saved", "zs"]
    no_turns = F.lit(None).cast(dict(classes.dtypes)["zs"])
    up = None
    for depth in range(top, -1, -1):
        here = ended.where(F.col("n") == depth).select("k1", "k2", "conv", F.col("members").alias("n_convs"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "zs")
        if up is not None:
            here = here.unionByName(up)
        if depth in tops:
            here = here.unionByName(tops[depth].select("k1", "k2", "conv", "n_convs", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), "saved", no_turns.alias("zs")))
        level = here.groupBy("k1", "k2").agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "kids", "leaves", "saved")), F.any_value("zs", True).alias("zs"))
        if depth and depth % band == 0:  # what came up from the band below knows its turns no longer
            level = level.drop("zs").join(bands.where(F.col("band") == depth // band - 1).select("conv", "zs"), "conv")
        z = F.get("zs", F.lit((depth - 1) % band)) if depth else F.struct(zero.alias("z1"), zero.alias("z2"), zero.alias("chars"))
        level = level.withColumn("z", z).select(
            "k1", "k2", *(F.when(F.lit(depth > 0), F.col(k).bitwiseXOR(F.col(f"z.{c}"))).alias(p) for k, c, p in (("k1", "z1", "p1"), ("k2", "z2", "p2"))),
            F.lit(depth).cast("long").alias("depth"), "conv", "n_convs", F.col("kids").alias("n_children"),
            F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("z.chars")).alias("saved"), "zs",
        )
        level = saved(level)
        found.append(level.drop("zs"))
        up = level.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv", "n_convs", F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), "saved", "zs").select(*adds) if depth else None

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    piece = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("piece")
    pieces = whole.groupBy("k1", "k2", F.shiftright("conv", _CHUNK).alias("chunk")).agg(piece)
    ends = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(_hashes_of_lists, "k1 long, k2 long, ends string")
    parents = every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    named = every.join(parents, ["p1", "p2"], "left").join(ends, ["k1", "k2"], "left")
    return named.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
