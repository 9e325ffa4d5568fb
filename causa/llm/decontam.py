"""Benchmark decontamination: BM25 over an inverted index of the test items.

The index holds the items' terms with their BM25 weights, divided by the score
that an item gives itself, so one threshold serves all items. Items lie in
blocks; the index keeps each term's largest weight in each block that has it,
and so grows with the items' words. Every passage of every document is a query:
block-max WAND passes over blocks whose summed maxima can't reach the threshold,
then over items by their own remaining bounds, and scores the rest exactly.
Everything above the threshold is retrieved and then verified: shared runs of
words in the passage must cover the item, its question and its answer.

Document frequencies and the mean length are those of all items, whatever their
number. Items are read in slices of bounded size; each slice's index is
broadcast, and a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causa.llm.common import saved

K1, B = 1.2, 0.75
BLOCK = 8
SHINGLE = 5
THRESHOLD = 0.7
OVERLAP = 0.8
SLICE_BYTES = 8 << 20
_CELLS = 1 << 22  # sums of block maxima that are held at once
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_LATIN = bytes(i if _WORD.fullmatch(chr(i)) else 32 for i in range(256))


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


@dataclass(frozen=True)
class Rows:
    """A sparse matrix by rows; the columns of a row ascend."""

    shape: tuple[int, int]
    begin: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def __getitem__(self, row: int) -> list[tuple[int, float]]:
        own = slice(self.begin[row], self.begin[row + 1])
        return list(zip(self.column[own].tolist(), self.value[own].tolist(), strict=True))

    def bytes(self) -> int:
        return self.begin.nbytes + self.column.nbytes + self.value.nbytes


@dataclass(frozen=True)
class Index:
    ids: list
    terms: dict[str, int]
    postings: Rows  # terms x items: weights
    bound: Rows  # terms x blocks: largest weight of a term in a block
    first: np.ndarray  # of each entry of bound: its first posting; one more at the end
    top: np.ndarray  # by term: largest weight of all
    tokens: list[list[str]]
    answers: list[int]  # word number at which the answer begins
    longest: int


def build_index(items: list[tuple], block: int = BLOCK, stats: tuple[int, float, dict[str, int]] | None = None) -> Index:
    """items: (id, text) with at least one word each; in order of id. The last sentence of an item is its answer.

    stats: number and mean length of all items, and in how many of them each word of these occurs.
    """
    tokens = [words(t) for _, t in items]
    order = sorted(range(len(items)), key=lambda i: len(tokens[i]))  # alike lengths make tight block bounds
    items, tokens = [items[i] for i in order], [tokens[i] for i in order]
    n, mean, df = stats or (len(items), sum(map(len, tokens)) / max(1, len(items)), Counter(t for own in tokens for t in set(own)))
    terms = {t: k for k, t in enumerate(sorted({t for own in tokens for t in own}))}
    found: list[list] = [[], [], []]
    for i, own in enumerate(tokens):
        raw = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(own) / mean)) for t, c in Counter(own).items()}
        total = sum(raw.values())
        for column, v in zip(found, (map(terms.get, raw), repeat(i, len(raw)), (w / total for w in raw.values())), strict=True):
            column.extend(v)
    term, item, weight = np.array(found[0], np.int64), np.array(found[1], np.int32), np.array(found[2], np.float64)
    by = np.lexsort((item, term))
    term, item, weight = term[by], item[by], weight[by]
    starts = lambda sorted_terms: np.searchsorted(sorted_terms, np.arange(len(terms) + 1))
    first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(item // block, prepend=-1))
    most = np.maximum.reduceat(weight, first) if len(first) else weight
    bound = Rows((len(terms), -(-len(items) // block)), starts(term[first]), item[first] // block, most)
    top = np.maximum.reduceat(most, bound.begin[:-1]) if len(terms) else most
    answers = []
    for _, text in items:
        parts = [len(words(x)) for x in _SENTENCE.split(text) if words(x)]
        answers.append(sum(parts[:-1]) if len(parts) > 1 else 0)
    return Index([i for i, _ in items], terms, Rows((len(terms), len(items)), starts(term), item, weight), bound, np.append(first, len(term)), top, tokens, answers, max(map(len, tokens), default=0))


def _entries(index: Index, terms: np.ndarray) -> np.ndarray:
    """Numbers of the entries of bound of some terms, in their order."""
    end = index.bound.begin[terms + 1]
    size = end - index.bound.begin[terms]
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())


def wand(index: Index, query: set[int], blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Items of the given blocks whose score for a set of terms reaches the threshold.

    Cursors run over the postings of the query's terms, sorted by item; the pivot
    is the first item whose preceding terms' block maxima can reach the threshold.
    """
    found = []
    entry = _entries(index, np.array(sorted(query), np.int64))
    held = index.bound.column[entry]
    for b in blocks.tolist():
        lists = []  # items, their weights, place of the cursor, largest weight
        for e in entry[held == b].tolist():
            part = slice(index.first[e], index.first[e + 1])
            lists.append([index.postings.column[part].tolist(), index.postings.value[part].tolist(), 0, float(index.bound.value[e])])
        lists.sort(key=lambda c: c[0][0])
        while lists:
            reach, pivot = 0.0, -1
            for k, c in enumerate(lists):
                reach += c[3]
                if reach >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]]
            if lists[0][0][lists[0][2]] == item:
                score = 0.0
                for c in lists:
                    if c[0][c[2]] != item:
                        break
                    score += c[1][c[2]]
                    c[2] += 1
                if score >= threshold:
                    found.append((item, score))
            else:
                for c in lists[:pivot]:
                    c[2] = bisect_left(c[0], item, c[2])
            lists = [c for c in lists if c[2] < len(c[0])]
            lists.sort(key=lambda c: c[0][c[2]])
    return found


class _Grams:
    """Runs of words of a text; those of one length are listed once."""

    def __init__(self, own: list[str]):
        self.own, self.lists = own, {}

    def share(self, part: list[str], shingle: int, lo: int, hi: int) -> float:
        """Share of a word sequence's runs that the words [lo, hi) of the text hold; 1 for an empty one."""
        n = min(shingle, len(part))
        if not n:
            return 1.0
        if n not in self.lists:
            self.lists[n] = list(zip(*(self.own[i:] for i in range(n)), strict=False))
        wanted = set(zip(*(part[i:] for i in range(n)), strict=False))
        return len(wanted.intersection(self.lists[n][lo : max(lo, hi - n + 1)])) / len(wanted)


def _passages(index: Index, codes: np.ndarray, threshold: float) -> list[tuple[int, set[int], np.ndarray]]:
    """(passage, its terms, blocks whose summed maxima reach the threshold).

    Passages are windows of two stretches of the longest item's length, one
    stretch apart, so each place where an item can stand lies inside a passage.
    """
    at = np.flatnonzero(codes >= 0)
    if not len(at):
        return []
    terms, blocks = index.bound.shape
    count = -(-len(codes) // index.longest)
    pairs = np.unique(at // index.longest * terms + codes[at])
    stretch, term = pairs // terms, pairs % terms
    reach = np.bincount(stretch, index.top[term], count + 1)
    near = np.flatnonzero(reach[:-1] + reach[1:] >= threshold * 0.9999)  # a passage's maxima over all blocks
    found = []
    step = max(1, _CELLS // blocks)
    for low in range(0, count if len(near) else 0, step):
        part = near[np.searchsorted(near, low) : np.searchsorted(near, low + step)]
        if not len(part):
            continue
        own = slice(*np.searchsorted(stretch, (low, low + step + 1)))
        entry = _entries(index, term[own])
        size = index.bound.begin[term[own] + 1] - index.bound.begin[term[own]]
        cell = np.repeat((stretch[own] - low) * blocks, size) + index.bound.column[entry]
        sums = np.bincount(cell, index.bound.value[entry], (step + 1 if step < count else count + 1) * blocks).reshape(-1, blocks)
        upper = (sums[part - low] + sums[part - low + 1]).max(axis=1)  # both stretches may hold a term: an upper bound
        for k in part[upper >= threshold * 0.9999].tolist():
            query = np.unique(term[slice(*np.searchsorted(stretch, (k, k + 2)))])
            entry = _entries(index, query)
            hit = np.flatnonzero(np.bincount(index.bound.column[entry], index.bound.value[entry], blocks) >= threshold * 0.9999)
            if len(hit):
                found.append((k, set(query.tolist()), hit))
    return found


def search(text: str, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """(item, passage score, question overlap, answer overlap) of a text's verified items.

    All passages that reach the threshold for an item are verified, in the
    passage and the stretch after it; of those that hold the item the best score counts.
    """
    own = words(text)
    if not own:
        return []
    codes = np.fromiter(map(index.terms.get, own, repeat(-1)), np.int64, len(own))
    best: dict[int, tuple[float, float, float]] = {}
    grams = _Grams(own)
    for k, query, blocks in _passages(index, codes, threshold):
        lo, hi = k * index.longest, (k + 3) * index.longest
        for item, score in wand(index, query, blocks, threshold):
            if score <= best.get(item, (0.0,))[0]:
                continue
            tokens, at = index.tokens[item], index.answers[item]
            if grams.share(tokens, SHINGLE, lo, hi) >= overlap:
                question, answer = grams.share(tokens[:at], SHINGLE, lo, hi), grams.share(tokens[at:], SHINGLE, lo, hi)
                if min(question, answer) >= overlap / 2:
                    best[item] = score, question, answer
    return [(item, *v) for item, v in best.items()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): a row per row of docs and item that it holds.

    Null texts and items without a word match nothing; repeated items each
    match; repeated rows each give their matches; without items or documents the
    result is empty. A null id is kept as it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    result = None
    for index in indexes(items, item_col, item_text_col, slice_bytes):

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = x.as_py()
                    for item, score, question, answer in search(text, ix, threshold, overlap) if text and ix.ids else ():
                        for column, v in zip(out, (i, ix.ids[item], score, question, answer), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(run, "id long, item_id long, score double, question_overlap double, answer_overlap double")
        result = found if result is None else result.unionByName(found)
    return result.withColumnRenamed("id", id_col)


def indexes(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> list:
    """Broadcast indexes of the items, each of about slice_bytes of text at most; one at least.

    Words are counted over all items by Spark; a slice takes the counts of its own words only.
    """
    spark = items.sparkSession
    slim = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))

    def run(batches):
        for b in batches:
            held = [(s, w) for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) if (w := words(x.as_py()))]
            sizes, own = pa.array([len(w) for _, w in held], pa.int64()), pa.array([sorted(set(w)) for _, w in held], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int32()), sizes, own], ["slice", "size", "words"])

    dealt = slim.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices)).cast("int"))
    if slices == 1:  # these items are all items
        held = dealt.select("item", "text").collect()
        return [spark.sparkContext.broadcast(build_index(_ordered(held)))]
    counted = saved(dealt.select("slice", "text").mapInArrow(run, "slice int, size long, words array<string>"))
    n, mean = counted.agg(F.count(F.lit(1)), F.avg("size")).first()
    each = counted.select("slice", F.explode("words").alias("word"))
    df = saved(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(each.distinct(), "word").select("slice", "word", "n"))
    out = []
    for k in range(slices):
        own = {r["word"]: r["n"] for r in df.where(F.col("slice") == k).toLocalIterator()}
        held = dealt.where(F.col("slice") == k).select("item", "text").toLocalIterator()
        out.append(spark.sparkContext.broadcast(build_index(_ordered(held), stats=(n, mean, own))))
    return out


def _ordered(rows) -> list[tuple]:
    return sorted(((r["item"], r["text"]) for r in rows if words(r["text"])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs that hold no item, with all their columns and without a shuffle."""
    for index in indexes(items):
        docs = docs.where(~_holds(index, threshold, overlap)(F.col(text_col).cast("string")))
    return docs


def _holds(index, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(x and index.value.ids and search(x, index.value, threshold, overlap)) for x in texts], dtype=bool)

    return holds
