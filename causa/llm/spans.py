"""Removal of repeated passages by sliding runs of words.

A run is the shortest stretch of whole sentences that begins at a sentence, or
that ends at one (both, so that a repeated passage is covered to its last
sentence), and has `sentences` sentences and `words` words, or REACH words in
any number of sentences. Besides, REACH words form a run from each word whose
hash is the least of some STRIDE words in a row, wherever sentences end; so any
two copies of a passage of STRIDE + REACH - 1 words share a run. Texts are cut
at sentences and at both ends of such runs. All runs of a text are hashed at
once from sums over the hashes of its words.

The corpus joins on (run, document), each run once per document; which
document has a run first is found by minima that are combined before the
exchange. Later ones lose the pieces that the run covers. Runs that come again
in the same document need no join: its own first one stays, the others go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causa.llm.common import mix, powers, saved

SENTENCES = 3
WORDS = 12
REACH = 25
STRIDE = 20
_BASE, _BASE_2, _SALT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D
_BLOCK = 1 << 18  # signs of a text that are hashed together
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])  # no white space comes after U+3000
_STOP = np.isin(np.arange(0x3002), [ord(c) for c in ".!?"])


def _lower(text: str) -> str:
    """Lower case, sign for sign."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _hashes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the stretches [start, end) of a sequence; starts and ends ascend. Long sequences are taken in blocks."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = int(ends[to - 1])
        up, down = powers(hi - lo + 1, base)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((signs[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        begin = starts[at:to] - lo
        out[at:to] = mix((sums[ends[at:to] - lo] - sums[begin]) * down[begin])
        at = to
    return out


def _layout(text: str, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the pieces, and for each run its first and last piece and both halves of its hash; runs in order of first and last word.

    A piece begins with a word, but for the first, which begins with the text.
    """
    none = np.zeros(0, np.int64)
    signs = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)
    space = _SPACE[signs]
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = change[::2], change[1::2]
    n = len(starts)
    if not n:
        return np.array([0, len(text)][: 1 + bool(text)]), none, none, none, none
    lines = np.searchsorted(np.flatnonzero(signs == 10), starts)
    stops = _STOP[signs[ends[:-1] - 1]] | (np.diff(lines) > 0)
    bounds = np.concatenate([[0], np.flatnonzero(stops) + 1, [n]])
    lower = np.frombuffer(_lower(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _hashes(lower, starts, ends, _BASE)
    begins = none
    if n >= max(STRIDE, REACH):
        # the low half holds the place, so the leftmost of equal words wins
        low, reach = (word & np.uint64(0xFFFFFFFF << 32)) | np.arange(n, dtype=np.uint64), 1
        while 2 * reach <= STRIDE:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < STRIDE:
            low = np.minimum(low[: len(low) - (STRIDE - reach)], low[STRIDE - reach :])
        begins = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = begins[np.diff(begins, prepend=-1) > 0]
        begins = begins[begins + REACH <= n]
    m = len(bounds) - 1
    at = np.arange(m)
    # the sentence bound of the shortest stretch with enough sentences and words
    ahead = np.minimum(np.maximum(at + least, np.searchsorted(bounds, bounds[:-1] + words)), np.searchsorted(bounds, bounds[:-1] + REACH))
    behind = np.maximum(np.minimum(at + 1 - least, np.searchsorted(bounds, bounds[1:] - words, "right") - 1), np.searchsorted(bounds, bounds[1:] - REACH, "right") - 1)
    fits, reaches = ahead <= m, behind >= 0
    first = np.concatenate([begins, bounds[:-1][fits], bounds[behind[reaches]]])
    last = np.concatenate([begins + REACH, bounds[ahead[fits]], bounds[1:][reaches]])
    code = np.unique(first << 32 | last)
    first, last = code >> 32, code & 0xFFFFFFFF
    edge = np.zeros(n + 1, bool)
    edge[bounds] = edge[begins] = edge[begins + REACH] = True
    piece = np.cumsum(edge[:-1]) - 1
    edges = np.append(starts[edge[:-1]], len(text))
    edges[0] = 0
    up, down = powers(n + 1, _BASE_2)
    halves = []
    for own in (word, mix(word ^ np.uint64(_SALT))):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * up[:-1], out=sums[1:])
        halves.append(mix((sums[last] - sums[first]) * down[first]).view(np.int64))
    return edges, piece[first], piece[last - 1], *halves


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of the pieces that cover a text: sentences, which end at . ! ? before white space and at line feeds, cut where runs across them begin and end."""
    edges = _layout(text, SENTENCES, WORDS)[0].tolist()
    return list(zip(edges, edges[1:], strict=False))


def runs(text: str, spans: list[tuple[int, int]], least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, tuple[int, int]]]:
    """(first, last, 16-byte hash) of each run; blank pieces belong to the run around them."""
    _, first, last, hi, lo = _layout(text, least, words)
    return list(zip(first.tolist(), last.tolist(), zip(hi.tolist(), lo.tolist(), strict=True), strict=True))


def _dead(pieces: int, first: np.ndarray, last: np.ndarray, hi: np.ndarray, lo: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which pieces a text loses: those under the runs in gone, and under all but the first of runs that come again in it."""
    again = np.isin(hi, gone) if len(gone) else np.zeros(len(hi), bool)
    by = np.argsort(hi, kind="stable")
    again[by[1:][(hi[by[1:]] == hi[by[:-1]]) & (lo[by[1:]] == lo[by[:-1]])]] = True
    dead = np.bincount(first[again], minlength=pieces + 1) - np.bincount(last[again] + 1, minlength=pieces + 1)
    return np.cumsum(dead)[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(id_col, text, n_sentences, n_removed, n_spans, n_removed_words) of every row.

    text is what is left, n_sentences counts its pieces (see sentences), n_spans
    maximal stretches of removed ones. Earlier is the smaller id, then the
    smaller hash of the text, then the earlier piece. Null texts stay null and
    count no sentence; texts shorter than a run are left alone. Rows with one id
    and different texts, or without an id, are different documents; rows equal
    in both are one document that is given back as often as it came. A null id
    comes before all others. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("own", F.xxhash64("text"))

    def hashed(with_document: bool):
        def run(batches):
            for b in batches:
                his, los, numbers = [], [], []
                for k, x in enumerate(b.column(0)):
                    *_, hi, lo = _layout(x.as_py() or "", least, words)
                    hi, once = np.unique(hi, return_index=True)
                    his.append(hi)
                    los.append(lo[once])
                    numbers.append(np.full(len(hi), k))
                hi = pa.array(np.concatenate(his)) if his else pa.array([], pa.int64())
                if with_document:
                    at = pa.array(np.concatenate(numbers)) if numbers else pa.array([], pa.int64())
                    lo = pa.array(np.concatenate(los)) if los else pa.array([], pa.int64())
                    yield pa.RecordBatch.from_arrays([hi, lo, b.column(1).take(at), b.column(2).take(at)], ["hi", "lo", "id", "own"])
                else:
                    yield pa.RecordBatch.from_arrays([hi], ["hi"])

        return rows.select("text", "id", "own").mapInArrow(run, "hi long, lo long, id long, own long") if with_document else rows.select("text").mapInArrow(run, "hi long")

    # what is joined below is written before, so that both sides are dealt by it alone and AQE can split a hot run
    often = saved(hashed(False).groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi"))
    repeated = saved(hashed(True).join(often, "hi"))
    first = saved(repeated.groupBy("hi", "lo").agg(F.min(F.struct("id", "own")).alias("first"), F.max(F.struct("id", "own")).alias("last")).where("first <> last or (first.id is null) <> (last.id is null)").select("hi", "lo", "first"))
    later = repeated.join(first, ["hi", "lo"]).where(~F.struct("id", "own").eqNullSafe(F.col("first")))
    gone = saved(later.groupBy("id", "own").agg(F.collect_set("hi").alias("gone")).select(F.col("id").alias("gone_id"), F.col("own").alias("gone_own"), "gone"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone_own")), "left").select("id", "text", "gone")

    def drop(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for x, a in zip(b.column(1), b.column(2), strict=True):
                text = x.as_py()
                edges, *found = _layout(text or "", least, words)
                dead = _dead(len(edges) - 1, *found, a.values.to_numpy() if a.is_valid else none)
                kept, cut = text, 0
                if dead.any():
                    spans = list(zip(edges.tolist(), edges.tolist()[1:], dead.tolist(), strict=False))
                    kept = "".join(text[s:e] for s, e, d in spans if not d)
                    cut = sum(len(text[s:e].split()) for s, e, d in spans if d)
                for column, v in zip(out, (kept, len(dead), int(dead.sum()), int((np.diff(dead.astype(np.int8), prepend=0) > 0).sum()), cut), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["id", "text", "n_sentences", "n_removed", "n_spans", "n_removed_words"])

    return joined.mapInArrow(drop, "id long, text string, n_sentences long, n_removed long, n_spans long, n_removed_words long").withColumnRenamed("id", id_col)
