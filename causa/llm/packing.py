"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters for the packing, and there are
at most `capacity` lengths; so the search works on that histogram, whatever the
number of documents. It fills one kind of bin at a time: the largest piece that
is left, completed by an undominated filling, first repeated as often as the counts
allow, then less often. Best-fit decreasing gives the first incumbent; some fillings of
little waste are tried first, then all others; a branch is cut once its waste can't beat the incumbent, and
the rest of each node is packed best-fit for further incumbents. Spark then
ranks the pieces of each length and looks up their places.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causa.llm.common import cut

CAPACITY = 2048
CACHE_WORDS = 600_000
NODES = 6000
_ODD = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
_FAR = re.compile("[^\x00-\u012f]")
_SIGNS = ".,;:!?*#$%&()+-=_/"
_coders: dict[str, tuple] = {}

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _coder(path: str) -> tuple:
    """The tokenizer, its added tokens (text to id) and the ids of the words met so far."""
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        _coders[path] = coder, {t.content: i for i, t in coder.get_added_tokens_decoder().items()}, {}
    return _coders[path]


def _encoded(words: list[str], coder, added: dict[str, int]) -> Iterator[bytes]:
    """Ids of each word. None holds an added token, so one between all words tells where each one's ids end."""
    if not added:
        yield from (array("I", e.ids).tobytes() for e in coder.encode_batch(words, add_special_tokens=False))
        return
    mark, number = next(iter(added.items()))
    ids = np.array(coder.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
    ends = [*(4 * np.flatnonzero(ids == number)).tolist(), 4 * len(ids)]
    raw, at = ids.tobytes(), 0
    for end in ends:
        yield raw[at:end]
        at = end + 4


def token_bytes(text: str, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a text.

    This tokenizer splits at white space and between letters and other signs and
    lower-cases, so words are encoded once, kept, and joined with the signs after
    them. Texts with an added token in them, in any case, are encoded as they are.
    """
    coder, added, known = _coder(path)
    low = text.lower()
    if _ODD.search(text) or any(t.lower() in low for t in added):
        return np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if not _FAR.search(text):  # below U+0130 lower case is one sign for one and nothing composes
        text = low
    words = text.split()
    new = {w for w in words if w not in known}
    if new:
        if len(known) > CACHE_WORDS:
            known.clear()
            new = set(words)
        ended = [(w, head, w[len(head) :]) for w in new if w[-1] in _SIGNS and (head := w.rstrip(_SIGNS)).isalpha() and head.lower().isalpha()]
        new.difference_update(w for w, _, _ in ended)
        new.update(x for _, head, tail in ended for x in (head, tail) if x not in known)
        for at in range(0, len(part := list(new)), 200):
            known.update(zip(part[at : at + 200], _encoded(part[at : at + 200], coder, added), strict=True))
        for w, head, tail in ended:
            known[w] = known[head] + known[tail]
    return b"".join(map(known.__getitem__, words))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank) of every row; rank counts a task's pieces of one length."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        ranks = np.zeros(capacity + 1, np.int64)
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for i, text, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = token_bytes(text.as_py(), path) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, v in zip(out, (i, k, at // 4, n, zlib.crc32(own), part, ranks[n]), strict=True):
                        column.append(v)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    names, kinds = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of a histogram: patterns and how often each is used."""
    open_bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [pattern, bins]
    open_bins[capacity].append([(), int(counts.sum())])
    rooms = [capacity]  # sorted
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = rooms[bisect_left(rooms, length)]
            pattern, bins = open_bins[room].pop()
            each = min(room // length, left)
            used = min(bins, left // each)
            if bins > used:
                open_bins[room].append([pattern, bins - used])
            if not open_bins[room]:
                del rooms[bisect_left(rooms, room)]
            rest = room - each * length
            if not open_bins[rest]:
                insort(rooms, rest)
            open_bins[rest].append([(*pattern, (length, each)), used])
            left -= each * used
    return [(p, n) for group in open_bins for p, n in group if p]


def completions(first: int, counts: np.ndarray, capacity: int, most: int, tries: int = 4000) -> list[Pattern]:
    """A few good fillings beside one piece of length `first`, least waste first: those that the search tries before all others."""
    found: dict[Pattern, int] = {}
    lengths = np.flatnonzero(counts)[::-1]
    smallest = int(lengths[-1]) if len(lengths) else capacity + 1
    steps = 0

    def grow(pattern: list[tuple[int, int]], room: int, below: int) -> None:
        nonlocal steps
        steps += 1
        if steps > tries or len(found) >= 4 * most:
            return
        fit = lengths[np.searchsorted(-lengths, -min(room, below)) :]
        if room < smallest or not len(fit):
            # maximal among what is left of each length
            used = dict(pattern)
            if not any(counts[x] - used.get(x, 0) > 0 for x in range(1, room + 1)):
                found[tuple(pattern)] = room
            return
        for length in map(int, fit[: 3 * most]):
            copies = min(room // length, int(counts[length]))
            grow([*pattern, (length, copies)], room - copies * length, length - 1)
            if len(found) >= 4 * most or steps > tries:
                return

    own = counts.copy()
    own[first] -= 1
    counts = own
    lengths = np.flatnonzero(counts)[::-1]
    smallest = int(lengths[-1]) if len(lengths) else capacity + 1
    grow([], capacity - first, capacity)
    return sorted(found, key=found.get)[:most]


def fillings(first: int, counts: np.ndarray, capacity: int) -> Iterator[Pattern | None]:
    """All undominated fillings beside one piece of length `first`, longest pieces and most copies first; None after steps that give none.

    A filling is dominated (Martello and Toth) if a further piece fits, or if a
    longer piece that is left fits in place of one, or one as long as two of its
    pieces or longer in place of both.
    """
    own = counts.copy()
    own[first] -= 1
    lengths = np.flatnonzero(own)[::-1].tolist()

    def dominated(pattern: list[tuple[int, int]], room: int) -> bool:
        used = dict(pattern)
        left = [x for x in lengths if own[x] > used.get(x, 0)]
        pairs = [x + y for i, (x, n) in enumerate(pattern) for y, m in pattern[i:] if x != y or n > 1]
        longer = lambda low, high: any(low <= y <= high for y in left)
        return longer(1, room) or any(longer(x + 1, x + room) for x in used) or any(longer(x, x + room) for x in pairs)

    def grow(pattern: list[tuple[int, int]], room: int, at: int) -> Iterator[Pattern | None]:
        while at < len(lengths) and lengths[at] > room:
            at += 1
        if at == len(lengths):
            yield None if dominated(pattern, room) else tuple(pattern)
            return
        yield None
        for i in range(at, len(lengths)):
            for copies in range(min(room // lengths[i], int(own[lengths[i]])), 0, -1):
                yield from grow([*pattern, (lengths[i], copies)], room - copies * lengths[i], i + 1)

    yield from grow([], capacity - first, 0)


def moves(left: np.ndarray, capacity: int) -> Iterator[tuple[dict[int, int], int] | None]:
    """(whole pattern, times) of all ways to go on with the bin of the largest piece, most times first."""
    first = int(np.flatnonzero(left)[-1])
    early = completions(first, left, capacity, 3)
    for filling in chain(early, fillings(first, left, capacity)):
        if filling is None:
            yield None
            continue
        whole = dict(filling)
        whole[first] = whole.get(first, 0) + 1
        for times in range(min(int(left[x]) // c for x, c in whole.items()), 0, -1):
            yield whole, times


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns with their numbers of bins. Lengths run from 1 to capacity; counts[0] must be 0.

    Depth first over all undominated fillings of the bin of the largest piece and
    all numbers of such bins, a few of the least waste first. A node is cut if its
    waste can't lead below the incumbent; the rest of the first, second, fourth,
    ... node is packed best-fit for an incumbent early. Only `nodes`, the number
    of steps, ends the search before the optimum is proven.
    """
    total = int((counts * np.arange(len(counts))).sum())
    least = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))
    size = lambda plan: sum(n for _, n in plan)
    best = best_fit(counts, capacity)
    bins = size(best)
    if bins <= least:
        return best
    counts = counts.astype(np.int64)
    stack: list[tuple] = [(moves(counts, capacity), counts, None, 0, 0)]  # ways on, pieces left, (pattern, times, parent), bins used, waste
    seen = steps = 0

    def path(step) -> list[tuple[Pattern, int]]:
        plan = []
        while step is not None:
            plan.append(step[:2])
            step = step[2]
        return plan[::-1]

    while stack and bins > least and steps < nodes:
        steps += 1
        ways, left, parent, used, waste = stack[-1]
        if waste > (bins - 1) * capacity - total or (way := next(ways, False)) is False:
            stack.pop()
            continue
        if way is None:
            continue
        whole, times = way
        rest = left.copy()
        for x, c in whole.items():
            rest[x] -= c * times
        pattern = tuple(sorted(whole.items(), reverse=True))
        used, waste = used + times, waste + (capacity - sum(x * c for x, c in pattern)) * times
        if waste > (bins - 1) * capacity - total:
            continue
        step = pattern, times, parent
        if not rest.any():
            if used < bins:
                best, bins = path(step), used
            continue
        seen += 1
        if seen & (seen - 1) == 0:
            tail = best_fit(rest, capacity)
            if used + size(tail) < bins:
                best, bins = [*path(step), *tail], used + size(tail)
        stack.append((moves(rest, capacity), rest, step, used, waste))
    return best


def layout(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Slots sorted by length and rank. At most capacity patterns of 63 different lengths each come in a plan of best_fit's steps."""
    rows, taken, base = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for length, copies in pattern:
            rank = taken.get(length, 0)
            rows.append((length << 44 | rank, copies, base, offset, rank))
            taken[length] = rank + copies * bins
            offset += length * copies
        base += bins
    rows.sort()
    return dict(zip(("key", "copies", "base", "offset", "rank"), np.array(rows, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Every row is packed: a null or empty text is one piece of length 1, a text of
    more than `capacity` ids is cut every `capacity` ids, repeated rows give
    repeated pieces. An empty table gives an empty result.
    """
    own = cut(pieces(docs, id_col, text_col, capacity, tokenizer))
    by_part = own.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    slots = docs.sparkSession.sparkContext.broadcast(layout(bin_completion(counts, capacity)))

    def run(batches):
        s = slots.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(s["key"], length << 44 | rank, "right") - 1
            nth = rank - s["rank"][at]
            sequence, place = s["base"][at] + nth // s["copies"][at], s["offset"][at] + nth % s["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = own.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
