"""String similarity that Spark has no function for: vectorised, on distinct pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; a step per letter of b, all of a at once in the bits of a number."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence by the summed lengths."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """Best ratio among the sorted shared words and each side's shared and own words."""
    x, y = set(a.split()), set(b.split())
    shared = " ".join(sorted(x & y))
    one, two = (" ".join([*sorted(x & y), *sorted(z)]) for z in (x - y, y - x))
    if shared and (x <= y or y <= x):
        return 100.0
    return max(ratio(one, two), ratio(shared, one) if shared else 0.0, ratio(shared, two) if shared else 0.0)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against the longer one's windows of its length."""
    a, b = sorted((a, b), key=len)
    return max((ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)), default=100.0) if a else 0.0


#: Code points that are compared at once.
_CHUNK = 1 << 20


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _places(codes: np.ndarray, short: str) -> np.ndarray:
    """For each code point the places in a string of at most 63 letters that have it, as bits."""
    bits: dict[int, int] = {}
    for i, x in enumerate(_codes(short).tolist()):
        bits[x] = bits.get(x, 0) | 1 << i
    known = np.array(sorted(bits), np.uint32)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, np.array([bits[x] for x in sorted(bits)], np.uint64)[at], np.uint64(0))


def _common_of(column, width: int, size: int) -> np.ndarray:
    """_common() of one string of `size` letters with many of `width`; column(j): places of the letter j of each."""
    row = full = np.uint64((1 << size) - 1)
    for j in range(width):
        hit = row & column(j)
        row = ((row + hit) | (row - hit)) & full
    return size - np.bitwise_count(row).astype(np.int64)


def _near(lines: list[str], phrase: str, least: float) -> np.ndarray:
    """partial() >= least of each line, for lines that aren't empty: all windows of all lines at once."""
    m = len(phrase)
    sizes = np.array([len(x) for x in lines])
    out = np.zeros(len(lines), bool)
    wide = np.flatnonzero(sizes >= m)
    if len(wide):
        places = _places(_codes("".join(lines[i] for i in wide)), phrase)
        line = np.repeat(np.arange(len(wide)), sizes[wide])
        met = np.concatenate([[0], np.cumsum(places != 0)])
        starts = np.flatnonzero((line[: len(line) - m + 1] == line[m - 1 :]) & (200.0 * (met[m:] - met[:-m]) / (m + m) >= least))
        common = _common_of(lambda j: places[starts + j], m, m)
        out[wide[line[starts[200.0 * common / (m + m) >= least]]]] = True
    for n in set(sizes[sizes < m].tolist()):
        at = np.flatnonzero(sizes == n)
        codes = _codes("".join(lines[i] for i in at)).reshape(len(at), n)
        for k in range(m - n + 1):
            places = _places(codes, phrase[k : k + n])
            out[at] |= 200.0 * _common_of(lambda j, p=places: p[:, j], n, n) / (n + n) >= least
    return out


def resembles(line, phrase: str, least: float = 85):
    """Whether partial_ratio of a line and one phrase is `least` or more; false for an empty or missing line."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        codes, own = pd.factorize(x.where(x.notna(), "").astype(object))
        found, part, held = [], [], 0
        for n, s in enumerate(own, 1):
            part.append(s)
            held += len(s)
            if held >= _CHUNK or n == len(own):
                near = [partial(s, phrase) >= least for s in part] if len(phrase) > 63 else _near([s or "\0" for s in part], phrase, least)
                found.append(np.asarray(near, bool) & np.array([s != "" for s in part]))
                part, held = [], 0
        return pd.Series(np.concatenate(found)[codes] if found else np.zeros(0, bool))

    return run(line)


def _pairwise(score, name: str):
    def column(a, b):
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or r is None else score(p, r) for p, r in zip(x, y, strict=True)], dtype="float64")

        return run(a, b)

    column.__name__ = name
    return column


def may_resemble(line, phrase, least: int = 85):
    """False only where partial_ratio is below `least`: a window that reaches it lacks few letters of the shorter string,
    and each that is lacking or put in between spoils two or one of its pairs of letters."""
    short, long = F.when(F.length(line) < F.length(phrase), line).otherwise(phrase), F.when(F.length(line) < F.length(phrase), phrase).otherwise(line)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(short) - 1)), lambda i: F.substr(short, i, F.lit(2)))
    shared = F.size(F.filter(pairs, lambda p: F.contains(long, p)))
    return (F.length(line) > 0) & (shared >= F.length(short) - 1 - 3 * F.floor(F.length(short) * (100 - least) / 100))


token_set_ratio = _pairwise(token_set, "token_set_ratio")
partial_ratio = _pairwise(partial, "partial_ratio")
