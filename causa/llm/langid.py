"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (pairs and triples of letters,
hashed to 2^16 places). Document frequencies are counted over every learnable
row. Weights are trained with follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties) on at most about `train_rows` rows spread over the
labels. A further slice of that sample sets the temperature: its texts are told
apart whole almost without error, so pieces of them of 4 to 256 characters are
used too, and the temperature falls with the length of a text. The fitted weights
have a fixed size, so scoring is one pass over the texts with no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
PLACES = 1 << BITS
TRAIN_ROWS = 4000
UNKNOWN = "und"
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # PLACES x labels, IDF folded in
    bias: np.ndarray
    temperature: float  # of a long text
    short: float = 0.0  # how much hotter short ones are: by 1 + short / sqrt(number of n-grams)

    def heat(self, n: int) -> float:
        return self.temperature * (1 + self.short / max(n, 1) ** 0.5)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with a zero for everything that isn't a letter, and at both ends."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(c) + 2, np.uint32)
    out[1:-1] = np.where(_letters[0][c], c, 0)
    return out


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Places of the pairs with a letter and of the triples around a letter."""
    a, b = codes[:-1], codes[1:]
    pairs = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    mid = codes[1:-1]
    triples = (pairs[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - BITS)
    return np.concatenate([pairs[(a > 0) | (b > 0)] >> shift, triples[mid > 0] >> shift])


def _places(text: str) -> np.ndarray:
    return ngrams(_codes(text)) if text else np.zeros(0, np.uint32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of all rows of a one-column frame: in how many texts each place occurs, and the number of texts.

    Each task adds up its own rows; what reaches the driver has PLACES rows at most.
    """

    def run(batches):
        df, n = np.zeros(PLACES + 1, np.int64), 0
        for b in batches:
            for x in b.column(0):
                seen = np.zeros(PLACES, bool)
                seen[_places(x.as_py() or "")] = True
                df[:-1] += seen
                n += 1
        df[PLACES] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["place", "n"])

    out = np.zeros(PLACES + 1, np.int64)
    for r in texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out[:-1], int(out[-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal for softmax regression on (places, values, label) rows; last row of the result: bias."""
    z, n = np.zeros((PLACES + 1, labels)), np.zeros((PLACES + 1, labels))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, scale: float = 40.0) -> Model:
    """A model of the non-null labels of docs. No labelled text gives a model without labels."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0), 1.0)
    df, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)).clip(min=0) * scale

    share = F.create_map(*(F.lit(x) for k in labels for x in (k, int(min(1.0, train_rows / len(labels) / sizes[k]) * 1e9))))
    draw = F.pmod(F.xxhash64(F.lit(11), "id", F.crc32(F.col("text").cast("binary"))), F.lit(1_000_000_000))
    sample = rows.where(draw < F.try_element_at(share, F.col("label"))).select("text", "label", (F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(5)) == 0).alias("calibrate"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text, label, calibrate in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for part in [text, *(pieces(text) if calibrate else [])]:
                    places, n = np.unique(_places(part), return_counts=True)
                    out.append((places.astype(np.int32), n.astype(np.int32), label, calibrate))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["places", "counts", "label", "calibrate"])

    train, held = [], []
    drawn = sample.mapInArrow(run, "places array<int>, counts array<int>, label string, calibrate boolean").toArrow()  # about train_rows rows, and pieces of a fifth of them
    for places, counts, label, calibrate in zip(*(drawn[n] for n in ("places", "counts", "label", "calibrate")), strict=True):
        at, n = places.values.to_numpy().astype(np.int64), counts.values.to_numpy().astype(np.float64)
        if len(at):
            x = np.append(n / n.sum() * idf[at], 1.0)
            (held if calibrate.as_py() else train).append((np.append(at, PLACES), x, labels.index(label.as_py()), int(n.sum())))
    w = ftrl([r[:3] for r in train], len(labels))
    held = held or train
    logits, y = np.array([x @ w[at] for at, x, *_ in held]).reshape(-1, len(labels)), np.array([r[2] for r in held], np.int64)
    heat = temperature(logits, y, np.array([r[3] for r in held])) if len(y) else (1.0, 0.0)
    return Model(labels, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], *heat)


#: Lengths of the pieces that the temperature is set by, in characters, and the grid of temperatures.
PIECES = (4, 8, 16, 32, 64, 256)
GRID = np.geomspace(0.005, 200, 300)
SHORT = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0)


def pieces(text: str) -> list[str]:
    """One piece of each length, from places spread by the text itself."""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    return [text[s : s + n] for n in PIECES if len(text) > n for s in [at * n % (len(text) - n)]]


def temperature(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(temperature, short): the divisor temperature * (1 + short / sqrt(n)) of the logits of texts of n n-grams that makes the labels y likeliest; the grid's steps are 3.6 per cent."""
    row, best = np.arange(len(y)), (np.inf, 1.0, 0.0)
    for short in SHORT:
        cool = logits / (1 + short / np.sqrt(n))[:, None]
        for t in GRID:
            loss = -np.log(_softmax(cool / t)[row, y] + 1e-12).sum()
            best = min(best, (float(loss), float(t), float(short)))
    return best[1], best[2]


def identify(text: str | None, model: Model) -> tuple[str, float]:
    """Label and calibrated probability of one text."""
    codes = _codes(text) if text and model.labels else np.zeros(2, np.uint32)
    if not codes.any():
        return UNKNOWN, 0.0
    total, n = np.zeros(len(model.labels)), 0
    for at in range(0, max(1, len(codes) - 2), _CHUNK):  # the last two codes of a chunk begin the next
        h = ngrams(codes[at : at + _CHUNK + 2])
        total += model.weights[h].sum(axis=0, dtype=np.float64)
        n += len(h)
    p = _softmax((total / max(n, 1) + model.bias) / model.heat(n))
    return model.labels[int(p.argmax())], float(p.max())


def scorer(spark: SparkSession, model: Model):
    """A column function text -> struct(lang_pred, score); the model has a fixed size and is broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(x, sent.value) for x in texts], columns=["lang_pred", "score"])

    return score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row, from its whole text only.

    Null texts and texts without a letter are `und` with score 0; so is every
    text when no label was learned. Rows are kept as they are, repeats included.
    """
    score = scorer(docs.sparkSession, model)
    return docs.select(F.col(id_col), score(F.col(text_col).cast("string")).alias("p")).select(id_col, "p.*")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is never learned from: crc32 of its id as text leaves no rest by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
