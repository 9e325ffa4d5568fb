"""Exact removal of repeated byte strings with a distributed sparse suffix sort.

A byte goes if a string of `length` bytes that covers it also starts earlier. To
sort the suffixes at all positions would take `length` times the input; instead
each window of `length` bytes elects one anchor, the place of its smallest
hashed `seed`-byte string. Equal windows elect alike, so all windows can be
compared at their anchors, which are a few per cent of the positions:

1. each text lists its anchors with the windows that elected them; anchors whose
   seed string occurs once in the corpus are settled, none of their windows repeats;
2. the suffixes at the others are range-partitioned by their leading bytes, by
   splitters that Spark samples. Equal leading bytes share a bucket, so no pair
   with a common prefix of `seed` bytes lies across a boundary;
3. each bucket is sorted by a multikey quicksort over 8-byte words, which leaves
   runs of equal seeds; the windows of a run are compared and all but the
   earliest of equal ones are marked. A bucket is taken in parts of whole runs;
4. the windows of seeds that occur more than `hot` times are not sorted: which
   of equal ones is the earliest is found by minima over their hashes, combined
   before the exchange, so no task holds such a run;
5. marks are merged per document and the bytes removed.

Whole copies of a text are found by digest beforehand: they don't repeat the
sort, and a run never holds more than one copy of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causa.llm.common import cut, mix, powers, saved

LENGTH = 100
SEED = 40
HOT = 20_000
_PART = 50_000  # rows of a bucket that are compared together, and the rest of their last run
_CHUNK = 1 << 17  # bytes of texts that are handled together
_BLOCK = 1 << 20
_ROWS = 8_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_2 = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def rolling(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all strings of `width` bytes; they depend on the bytes only, not on the place."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n, base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text number, seed hash, anchor, first window, last window), a row per anchor; windows are named by their start."""
    parts, at = [], 0
    while at < len(texts):  # short texts are handled together
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= _CHUNK:
            size += len(texts[end])
            end += 1
        for lo in range(0, max(1, size - length + 1), _BLOCK):  # the windows of a block need length - 1 bytes more
            data = np.frombuffer(b"".join(texts[at:end]) if end - at > 1 else texts[at][lo : lo + _BLOCK + length - 1], np.uint8)
            sizes = [len(x) for x in texts[at:end]] if end - at > 1 else [len(data)]
            parts.append((lo, at, *_anchors(data, np.array(sizes, np.int64), length, seed)))
        at = end
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*((own + at, h, a + lo, f + lo, w + lo) for lo, at, own, h, a, f, w in parts), strict=True))


def _anchors(data: np.ndarray, sizes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    hashes = rolling(data, seed)
    # the rest of the word holds the place, so the leftmost of equal seeds wins
    low = (hashes & np.uint64(_MASK << 24 & _MASK)) | np.arange(len(hashes), dtype=np.uint64)
    wide, reach = length - seed + 1, 1
    if len(low) < wide:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + length <= ends[own])  # windows that don't reach into the next text
    place = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place))[: len(first)] - 1
    number = own[start[first]]
    begin = (ends - sizes)[number]
    return number, hashes[place[first]].view(np.int64), place[first] - begin, start[first] - begin, start[last] - begin


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and in that order the number of each row's class of equal rows.

    Each round splits all classes that still hold several rows by their next word.
    """
    order = np.arange(len(words))
    group = np.zeros(len(words), np.int64)
    open_rows = np.arange(len(words))  # positions in order
    for depth in range(words.shape[1]):
        if not len(open_rows):
            break
        key = words[order[open_rows], depth]
        by = np.lexsort((key, group[open_rows]))
        order[open_rows], key, own = order[open_rows][by], key[by], group[open_rows]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        # a class is named by the position of its first row
        group[open_rows] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        alone = new & np.append(new[1:], True)
        open_rows = open_rows[~alone]
    return order, group


def repeated_windows(supers: list[bytes], places: np.ndarray, length: int = LENGTH, seed: int = SEED) -> list[np.ndarray]:
    """For each super-window (the bytes of an anchor's windows; places: of the anchor in
    it) the starts in it of the windows that an earlier one holds too. The super-windows
    come in order of document and place.
    """
    marked = [np.zeros(0, np.int64)] * len(supers)
    wide = -(-seed // 8) * 8
    heads = b"".join(s[p : p + seed].ljust(wide, b"\0") for s, p in zip(supers, places.tolist(), strict=True))
    order, group = multikey_order(np.frombuffer(heads, ">u8").reshape(len(supers), -1).astype(np.uint64))
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(begin, len(group)))
    begin, size = begin[size > 1], size[size > 1]
    at, total = 0, np.cumsum(size)
    while at < len(begin):  # whole runs at a time
        end = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + _ROWS, "right")))
        n = size[at:end]
        rows = np.repeat(begin[at:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
        _mark(order[rows], group[rows], supers, length, marked)
        at = end
    return marked


def _mark(own: np.ndarray, group: np.ndarray, supers: list[bytes], length: int, marked: list[np.ndarray]) -> None:
    by = np.argsort(own)
    own, group = own[by], group[by]
    sizes = np.array([len(supers[i]) for i in own], np.int64)
    data = np.frombuffer(b"".join(supers[i] for i in own), np.uint8)
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(own)), counts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
    run, a, b = group[row].view(np.uint64), rolling(data, length)[at], rolling(data, length, _BASE_2)[at]
    key = a ^ (b * np.uint64(_BASE)) ^ (run * np.uint64(_BASE_2))
    by = np.argsort(key, kind="stable")  # windows stand in order, so the first of equal ones is the earliest
    same = key[by[1:]] == key[by[:-1]]
    pair = by[1:][same], by[:-1][same]
    equal = (a[pair[0]] == a[pair[1]]) & (b[pair[0]] == b[pair[1]]) & (run[pair[0]] == run[pair[1]])
    later = np.zeros(len(row), bool)
    later[pair[0][equal]] = True
    hit = np.flatnonzero(later)
    ends = np.flatnonzero(np.diff(row[hit], append=-1)) + 1 if len(hit) else np.zeros(0, np.int64)
    for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        marked[own[row[hit[lo]]]] = inside[hit[lo:hi]]


def _order(place: tuple[int | None, int, int]) -> tuple[bool, int, int, int]:
    return place[0] is not None, place[0] or 0, *place[1:]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[start, end) of the bytes under windows that begin at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    spans are the removed byte ranges [start, end) of the UTF-8 text; cut_out()
    applies them. A null text counts as empty; texts under `length` bytes stay
    whole. Rows with one id and different texts are different documents, in
    order of a hash of the text; rows equal in both are one document and come
    back as often as they came; a null id comes before all others. An empty
    table gives an empty result.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    # key only finds a document's places; id and own name it exactly wherever bytes are removed
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).withColumns({"own": F.xxhash64("body"), "key": F.xxhash64("id", "body")})
    slim = cut(rows.select("id", "key", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n")))
    # what is joined to is written before, so that both sides are dealt by the join alone and AQE can split a hot key
    lead = cut(slim.groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id")).alias("lead")))
    slim = cut(slim.join(lead, "digest").select("id", "key", "digest", "n", (F.col("id").eqNullSafe(F.col("lead.id"))).alias("leads")))

    def listed(with_place: bool):
        def run(batches):
            for b in batches:
                number, h, a, first, last = anchors(b.column(0).to_pylist(), length, seed)
                if with_place:
                    pack = a << 16 | (a - first) << 8 | (last - first)
                    yield pa.RecordBatch.from_arrays([pa.array(h), b.column(1).take(pa.array(number)), pa.array(pack)], ["h", "key", "pack"])
                else:
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

        return rows.select("body", "key").mapInArrow(run, "h long, key long, pack long" if with_place else "h long, n long")

    often = saved(listed(False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("hot")))
    # the sign marks the places of hot seeds
    places = listed(True).join(often, "h").groupBy("key").agg(F.collect_list(F.when(F.col("hot"), -1 - F.col("pack")).otherwise(F.col("pack"))).alias("packs"))
    heads = slim.where("leads").select(F.col("key").alias("lead_key")).distinct()
    places = places.join(heads, F.col("key") == F.col("lead_key")).select("lead_key", "packs")
    hit = saved(rows.join(places, F.col("key") == F.col("lead_key")).select("id", "own", "body", "packs"))

    def emit(batches):
        """Super-windows, equal ones of a batch once: the later ones are marked here (rows without bytes, place: their length)."""
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            seen: dict[tuple[bytes, int], int] = {}
            gone: dict[tuple[int | None, int], list[tuple[int, int]]] = {}
            for i, own, body, packs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                text, packs = body.as_py(), np.unique(packs.values.to_numpy())
                for pack in packs[packs >= 0].tolist():
                    a = pack >> 16
                    first = a - (pack >> 8 & 255)
                    window = text[first : first + (pack & 255) + length]
                    if len(window) < length:
                        continue
                    at = seen.setdefault((window, a - first), len(out[0]))
                    if at == len(out[0]):
                        for column, v in zip(out, (text[a : a + seed], window, a - first, i, own, first), strict=True):
                            column.append(v)
                        continue
                    here, there = (i, own, first), (out[3][at], out[4][at], out[5][at])
                    if _order(here) < _order(there):
                        out[3][at], out[4][at], out[5][at] = here
                        here, there = there, here
                    if here != there:
                        gone.setdefault(here[:2], []).append((here[2], here[2] + len(window)))
            for (i, own), spans in gone.items():
                for lo, hi in _merged(spans):
                    head = (lo * 0x9E3779B97F4A7C15 ^ own * 0xD1342543DE82EF95) & _MASK
                    for column, v in zip(out, (head.to_bytes(8, "big"), None, hi - lo, i, own, lo), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["head", "window", "place", "id", "own", "first"])

    suffixes = hit.mapInArrow(emit, "head binary, window binary, place int, id long, own long, first long")
    buckets = suffixes.repartitionByRange(F.col("head")).sortWithinPartitions("head")
    names = ["id", "own", "lo", "hi"]

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            known = pc.is_valid(b.column(1))
            done, b = b.filter(pc.invert(known)), b.filter(known)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(3), done.column(4), done.column(5), pc.add(done.column(5), pc.cast(done.column(2), pa.int64()))], names)
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= _PART:
                table = pa.Table.from_batches(held).combine_chunks()
                rest = pc.sum(pc.equal(table["head"], table["head"][-1])).as_py()  # the last run may go on
                held = table.slice(len(table) - rest).to_batches()
                if rest < len(table):
                    yield from compared(table.slice(0, len(table) - rest))
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(table):
        ids, own, first = table["id"].to_pandas(), table["own"].to_numpy(), table["first"].to_numpy()
        known, ids = ids.notna().to_numpy(), ids.fillna(0).to_numpy(np.int64)
        by = np.lexsort((first, own, ids, known))
        windows = table["window"].take(pa.array(by)).to_pylist()  # from here on in order of document and place
        ids, own, known, first = ids[by], own[by], known[by], first[by]
        places = table["place"].to_numpy()[by].astype(np.int64)
        # rows with equal id and text are one document
        twin = np.flatnonzero((np.diff(ids) == 0) & (np.diff(own) == 0) & (np.diff(first) == 0) & (known[1:] == known[:-1])) + 1
        again = [int(t) for t in twin if windows[t] == windows[t - 1]]
        if again:
            keep = np.ones(len(windows), bool)
            keep[again] = False
            windows = [windows[k] for k in np.flatnonzero(keep)]
            ids, own, known, first, places = ids[keep], own[keep], known[keep], first[keep], places[keep]
        marked = repeated_windows(windows, places, length, seed)
        spans = [(k, lo, hi) for k, starts in enumerate(marked) for lo, hi in intervals(starts + first[k], length)]
        for at in range(0, len(spans), 50_000):
            part = spans[at : at + 50_000]
            rows = np.array([x[0] for x in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows], mask=~known[rows]), pa.array(own[rows]), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], names)

    def hashed(batches):
        """Both hashes of each window of hot seeds."""
        for b in batches:
            for i, own, body, packs in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                text, starts, hashes = body.as_py(), [], []
                packs = packs.values.to_numpy()
                for pack in (-1 - np.unique(packs[packs < 0])).tolist():
                    first = (pack >> 16) - (pack >> 8 & 255)
                    data = np.frombuffer(text[first : first + (pack & 255) + length], np.uint8)
                    hashes.append([rolling(data, length), rolling(data, length, _BASE_2)])
                    starts.append(first + np.arange(len(hashes[-1][0])))
                if starts:
                    first = np.concatenate(starts)
                    alike = [pa.array(np.concatenate([h[k] for h in hashes]).view(np.int64)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*alike, pa.array([i.as_py()] * len(first), pa.int64()), pa.array([own.as_py()] * len(first), pa.int64()), pa.array(first)], ["a", "b", "id", "own", "first"])

    marks = buckets.mapInArrow(compare, "id long, own long, lo long, hi long")
    if not often.where("hot").isEmpty():
        windows = hit.where(F.exists("packs", lambda p: p < 0)).mapInArrow(hashed, "a long, b long, id long, own long, first long")
        place = F.struct("id", "own", "first")
        earliest = saved(windows.groupBy("a", "b").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "earliest"))
        later = windows.join(earliest, ["a", "b"]).where(~place.eqNullSafe(F.col("earliest")))
        marks = marks.unionByName(later.select("id", "own", F.col("first").alias("lo"), (F.col("first") + length).alias("hi")))
    marks = marks.groupBy(F.col("id").alias("mark_id"), F.col("own").alias("mark_own")).agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    touched = hit.select("id", "own", "body").join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("own") == F.col("mark_own"))).select("id", "body", "marks")

    def apply(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for body, marks in zip(b.column(1), b.column(2), strict=True):
                text = body.as_py()
                spans = [{"start": lo, "end": hi} for lo, hi in _merged([(m["lo"], m["hi"]) for m in marks.as_py()])]
                kept = cut_out(text, spans)
                for column, v in zip(out, (hashlib.sha256(text).hexdigest(), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans), strict=True):
                    column.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), span), strict=True))], ["id", "own_digest", "gone", "runs", "kept", "cuts"])

    edits = touched.mapInArrow(apply, "id long, own_digest string, gone long, runs long, kept string, cuts array<struct<start:bigint,end:bigint>>")
    edits = edits.dropDuplicates(["id", "own_digest"]).withColumnRenamed("id", "edit_id")
    done = slim.join(edits, F.col("id").eqNullSafe(F.col("edit_id")) & (F.col("digest") == F.col("own_digest")), "left")
    whole = ~F.col("leads") & (F.col("n") >= length)  # a later copy starts later everywhere
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))).otherwise(F.coalesce("cuts", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
    )


def cut_out(text: bytes, spans: list[dict]) -> bytes:
    """The bytes of a text that no span covers; spans are sorted and apart."""
    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
