"""Page flags, blocks and slices of page tables (doc_id, page_no, text).

Flags are computed in one projection; windows and groups then carry flags and
page numbers only, and texts are joined back for the pages that a block keeps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causa import catalogs
from causa.operators import items
from causa.sources import files

Anchors = Sequence[tuple[str, str, str | None]]
#: Different page texts that are broadcast with all that is read of them, if they are short together.
MANY = 100_000


def _flags(catalog: Mapping[str, str]) -> dict[str, Column]:
    signed = F.try_to_date(F.regexp_extract("text", catalogs.SIGNED_ON, 1), "dd/MM/yyyy")
    return {"signed_on": signed, **{n: F.col("text").rlike(p.replace("(?i)", "(?iu)", 1)) for n, p in catalog.items()}}


def page_flags(pages: DataFrame, catalog: Mapping[str, str] = catalogs.PAGE_FLAGS) -> DataFrame:
    """(doc_id, page_no, signed_on, one boolean per catalog entry); texts that many pages share are read once."""
    found = _flags(catalog)
    return items.with_shared_values(pages.select("doc_id", "page_no", "text"), "text", **found).select("doc_id", "page_no", *found)


def islands(flags: DataFrame) -> DataFrame:
    """Adds block: the first page of the run of consecutive pages with one signature date."""
    w = Window.partitionBy("doc_id", "signed_on").orderBy("page_no")
    run = flags.withColumn("run", F.col("page_no") - F.row_number().over(w))
    return run.withColumn("block", F.min("page_no").over(Window.partitionBy("doc_id", "signed_on", "run"))).drop("run")


def blocks(flags: DataFrame) -> DataFrame:
    """(doc_id, signed_on, first_page, last_page, has_ruling, starts_in_envelope, envelope_share) of signed runs."""
    envelope = F.col("envelope").cast("double")
    return (
        islands(flags.where("signed_on is not null")).groupBy("doc_id", "signed_on", F.col("block").alias("first_page"))
        .agg(F.max("page_no").alias("last_page"), F.bool_or("ruling").alias("has_ruling"), F.min_by("envelope", "page_no").alias("starts_in_envelope"), F.avg(envelope).alias("envelope_share"))
    )


def decision_block(flags: DataFrame) -> DataFrame:
    """The newest signed block that holds a ruling, doesn't start in an envelope and is half envelope at most."""
    fit = blocks(flags).where("has_ruling and not starts_in_envelope and envelope_share <= 0.5")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("signed_on"), "first_page"))
    return fit.withColumn("rank", rank).where("rank = 1").select("doc_id", "first_page", "last_page", "signed_on")


def fallback_block(flags: DataFrame, longest: int = 60) -> DataFrame:
    """The last block that holds a ruling, of those that a walk through the pages makes without signatures.

    A block begins at an opening or ruling page that is no envelope and runs on to the page before the next pure
    envelope, `longest` pages at most; the walk then looks for the next beginning after it. Stretches between pure
    envelopes are walked by folding their pages' flags, so that a stretch of any length has all its restarts.
    """
    pure = F.col("envelope") & ~F.col("ruling")
    begins = (F.col("opening") | F.col("ruling")) & ~F.col("envelope")
    part = F.sum(pure.cast("int")).over(Window.partitionBy("doc_id").orderBy("page_no"))
    page = F.struct("page_no", begins.alias("begins"), "ruling")
    parts = flags.withColumn("part", part).where(~pure).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    at = lambda flag: F.filter(F.transform("pages", lambda x, i: F.when(x[flag], i)), lambda i: i.isNotNull())
    walk = F.aggregate(at("begins"), F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) == 0) | (i >= F.element_at(a, -1) + longest), F.concat(a, F.array(i))).otherwise(a))
    ruled = F.filter(walk, lambda h: F.exists("rulings", lambda r: (r >= h) & (r < h + longest)))
    found = parts.withColumn("rulings", at("ruling")).select("doc_id", "pages", F.try_element_at(ruled, F.lit(-1)).alias("h")).where("h is not null")
    ends = found.select("doc_id", F.get("pages", F.col("h"))["page_no"].alias("first_page"), F.get("pages", F.least(F.col("h") + longest, F.size("pages")) - 1)["page_no"].alias("last_page"))
    return ends.groupBy("doc_id").agg(F.max(F.struct("first_page", "last_page")).alias("b")).select("doc_id", "b.*")


def last_ruling_block(flags: DataFrame, back: int = 25, ahead: int = 5) -> DataFrame:
    """From the opening page at most `back` before the last ruling to `ahead` pages after it; the whole document without a ruling."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = flags.withColumn("opened", F.last(F.when(F.col("opening") & ~F.col("envelope"), F.col("page_no")), ignorenulls=True).over(w))
    ends = seen.groupBy("doc_id").agg(F.min("page_no").alias("low"), F.max("page_no").alias("high"), F.max(F.when(F.col("ruling"), F.struct("page_no", "opened"))).alias("last"))
    near = F.when(F.col("last.opened") >= F.col("last.page_no") - back, F.col("last.opened"))
    return ends.select("doc_id", F.coalesce(near, F.col("last.page_no"), F.col("low")).alias("first_page"), F.coalesce(F.least(F.col("last.page_no") + ahead, F.col("high")), F.col("high")).alias("last_page"))


def document_kind(flags: DataFrame) -> DataFrame:
    """(doc_id, kind) by priority over the flags of all pages."""
    any_of = flags.groupBy("doc_id").agg(*(F.bool_or(n).alias(n) for n in ("motion", "settlement", "order", "appeal")))
    kind = F.when(F.col("motion"), "motion").when(F.col("settlement"), "settlement").when(F.col("order"), "order").when(F.col("appeal"), "appeal").otherwise("sentence")
    return any_of.select("doc_id", kind.alias("kind"))


def block_text(block: DataFrame, pages: DataFrame, before: int = 3, cover: int = 2) -> DataFrame:
    """(doc_id, text): the block's pages, some before it and the cover pages, each under its page label."""
    wanted = (F.col("page_no").between(F.col("first_page") - before, F.col("last_page"))) | (F.col("page_no") <= cover)
    rows = pages.join(block.select("doc_id", "first_page", "last_page"), "doc_id").where(wanted)
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("[p. "), p["page_no"].cast("string"), F.lit("] "), p["text"])), "\n")
    return rows.groupBy("doc_id").agg(joined.alias("text"))


def _exploded(docs: DataFrame, slices: Column) -> DataFrame:
    """A row per slice; projected before they are exploded, and exploded with nulls, so that no filter repeats the expression."""
    return docs.select("doc_id", slices.alias("slices")).select("doc_id", F.explode_outer("slices").alias("s")).where("s is not null").select("doc_id", "s.*")


def _anchor_marks(catalog: Anchors) -> dict[str, Column]:
    return {f"{side}_{k}": F.col("text").rlike(p) for k, start, end in catalog for side, p in (("start", start), ("end", end)) if p}


def _by_document(marks: DataFrame, *marked: Column | str, **facts: Column) -> DataFrame:
    """(doc_id, pages, facts, sheets): a row per document with the last page's number and an array of its pages with their marks, in order."""
    sheets = F.sort_array(F.collect_list(F.struct("page_no", *marked)))
    return marks.groupBy("doc_id").agg(F.max("page_no").alias("pages"), *(c.alias(n) for n, c in facts.items()), sheets.alias("sheets"))


def _anchor_facts(catalog: Anchors) -> dict[str, Column]:
    """Of a document: the first page that begins each kind."""
    return {f"first_{k}": F.min(F.when(F.col(f"start_{k}"), F.col("page_no"))) for k, _, _ in catalog}


def _ends(catalog: Anchors) -> list[str]:
    return [f"end_{k}" for k, _, end in catalog if end]


def _anchor_slices(catalog: Anchors, reach: int, open_end: int) -> Column:
    def piece(k: str, pattern: str | None) -> Column:
        f = F.col(f"first_{k}")
        if pattern is None:
            last = F.least(f + open_end, "pages")
        else:
            ends = F.filter("sheets", lambda x: x[f"end_{k}"] & (x["page_no"] > f) & (x["page_no"] < f + reach))
            last = F.coalesce(F.get(ends, F.lit(0))["page_no"], F.least(f + reach - 1, "pages"))
        return F.when(f.isNotNull(), F.struct(F.lit(k).alias("kind"), f.alias("first_page"), last.alias("last_page")))

    return F.array_compact(F.array(*(piece(k, end) for k, _, end in catalog)))


def anchors(pages: DataFrame, catalog: Anchors = catalogs.ANCHORS, reach: int = 80, open_end: int = 30) -> DataFrame:
    """(doc_id, kind, first_page, last_page): each kind from the first page that matches its start.

    It ends at the first later page of the `reach` pages that matches its end, or with the last of them; a kind without
    an end pattern runs on for `open_end` pages more. All kinds come from one pass over the texts.
    """
    marks = pages.select("doc_id", "page_no", *(c.alias(n) for n, c in _anchor_marks(catalog).items()))
    docs = _by_document(marks, *_ends(catalog), **_anchor_facts(catalog))
    return _exploded(docs, _anchor_slices(catalog, reach, open_end))


def anchor_ranges(pages: DataFrame, start: str, end: str, reach: int = 80) -> DataFrame:
    """(doc_id, first_page, last_page) of one kind of piece."""
    return anchors(pages, (("piece", start, end),), reach).drop("kind")


def _contents_marks(kinds: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Whether a text has the heading of a table of contents, and its lines that are entries: (line_no, kind, page)."""

    def entry(raw, i):
        line = F.trim(raw, F.lit(" \t\r\x0b\x0c"))
        page = F.regexp_extract(line, catalogs.CONTENTS_PAGE, 1).try_cast("int")
        kind = F.coalesce(*(F.when(line.rlike(p), k) for k, p in kinds))
        # the page and the kind are sought only in lines that end in a digit
        named = F.when(F.right(line, F.lit(1)).between("0", "9") & (F.length(line) >= 5) & (page >= 1), kind)
        return F.when(named.isNotNull(), F.struct(i.alias("line_no"), named.alias("kind"), page.alias("page")))

    return {"headed": F.col("text").rlike(catalogs.CONTENTS_HEADING), "entries": F.array_compact(F.transform(F.split("text", "\n"), entry))}


def _head(first: int) -> tuple[Column, Column]:
    """Of a document: whether its first pages have such a heading. Of a page: its entries, if it is one of them and has any."""
    head = F.col("page_no") <= first
    return F.bool_or(head & F.col("headed")), F.when(head & (F.size("entries") > 0), F.col("entries")).alias("entries")


def _contents_slices(kinds: Sequence[tuple[str, str]], reach: int) -> Column:
    """A kind begins where its first entry says and ends `reach` pages after its last one, before the next kind's beginning
    and with the file, but never before it begins. Of kinds that begin together, the one that is named first comes first.
    """
    lines = F.flatten(F.transform(F.filter("sheets", lambda p: p["entries"].isNotNull()), lambda p: F.transform(p["entries"], lambda e: F.struct(p["page_no"].alias("page_no"), e["line_no"].alias("line_no"), e["page"].alias("page"), e["kind"].alias("kind")))))

    def piece(lines, k: str):
        own = F.filter(lines, lambda e: e["kind"] == k)
        first = F.array_min(own)
        return F.when(F.size(own) > 0, F.struct(first["page"].alias("page"), first["page_no"].alias("page_no"), first["line_no"].alias("line_no"), F.array_max(F.transform(own, lambda e: e["page"])).alias("last"), F.lit(k).alias("kind")))

    def end(found, x, i):
        return F.greatest(F.least(x["last"] + reach, F.coalesce(F.get(found, i + 1)["page"] - 1, F.col("pages")), F.col("pages")), x["page"])

    # a value that is read more than once is bound as an array of one, so that it is computed once
    found = F.transform(F.array(lines), lambda e: F.sort_array(F.array_compact(F.array(*(piece(e, k) for k, _ in kinds)))))
    return F.transform(found, lambda f: F.transform(f, lambda x, i: F.struct(x["kind"].alias("kind"), x["page"].alias("first_page"), end(f, x, i).alias("last_page"))))[0]


def contents(pages: DataFrame, kinds: Sequence[tuple[str, str]] = catalogs.CONTENTS_KINDS, first: int = 15, reach: int = 8) -> DataFrame:
    """(doc_id, kind, first_page, last_page) from the table of contents within the first pages.

    A line of five characters or more that ends in a page number is an entry of the first kind that it names. A document
    whose first pages have no such heading gives none.
    """
    head = F.col("page_no") <= first
    marks = pages.select("doc_id", "page_no", *(F.when(head, c).alias(n) for n, c in _contents_marks(kinds).items()))
    headed, entries = _head(first)
    docs = _by_document(marks, entries, headed=headed).where("headed")
    return _exploded(docs, _contents_slices(kinds, reach))


_BLOCK = "struct<first_page:int,last_page:int>"
_SIGNED = "struct<signed_on:date,first_page:int,last_page:int>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _row(**values) -> Column:
    return F.struct(*(v.alias(n) for n, v in values.items()))


def _signed_block(sheets) -> Column:
    """decision_block() of the pages of one document, in one walk: a run is judged where the next one begins."""

    def closed(a):
        better = a["best"].isNull() | (a["signed_on"] > a["best"]["signed_on"])
        fit = a["signed_on"].isNotNull() & a["ruling"] & ~a["covered"] & (a["covers"] * 2 <= a["pages"]) & better
        return F.when(fit, _row(signed_on=a["signed_on"], first_page=a["first_page"], last_page=a["last_page"])).otherwise(a["best"])

    def step(a, x):
        cover = x["envelope"].cast("int")
        goes_on = (x["signed_on"] == a["signed_on"]) & (x["page_no"] == a["last_page"] + 1)
        longer = _row(signed_on=a["signed_on"], first_page=a["first_page"], last_page=x["page_no"], pages=a["pages"] + 1, covers=a["covers"] + cover, covered=a["covered"], ruling=a["ruling"] | x["ruling"], best=a["best"])
        other = _row(signed_on=x["signed_on"], first_page=x["page_no"], last_page=x["page_no"], pages=F.lit(1), covers=cover, covered=x["envelope"], ruling=x["ruling"], best=closed(a))
        return F.when(goes_on, longer).otherwise(other)

    start = _row(signed_on=_none("date"), first_page=_none("int"), last_page=_none("int"), pages=F.lit(0), covers=_none("int"), covered=_none("boolean"), ruling=_none("boolean"), best=_none(_SIGNED))
    found = F.transform(F.array(F.aggregate(sheets, start, step, closed)), lambda b: F.when(b.isNotNull(), _row(first_page=b["first_page"], last_page=b["last_page"])))
    return found[0]


def _built_block(sheets, longest: int = 60) -> Column:
    """fallback_block() of the pages of one document, in one walk."""

    def closed(a):
        return F.when(a["ruling"], _row(first_page=a["first_page"], last_page=a["last_page"])).otherwise(a["found"])

    def step(a, x):
        begins = (x["opening"] | x["ruling"]) & ~x["envelope"]
        inside = a["first_page"].isNotNull() & (a["pages"] < longest)
        longer = _row(first_page=a["first_page"], last_page=x["page_no"], pages=a["pages"] + 1, ruling=a["ruling"] | x["ruling"], found=a["found"])
        fresh = _row(first_page=x["page_no"], last_page=x["page_no"], pages=F.lit(1), ruling=x["ruling"], found=closed(a))
        outside = _row(first_page=_none("int"), last_page=_none("int"), pages=F.lit(0), ruling=F.lit(False), found=closed(a))
        pure = x["envelope"] & ~x["ruling"]
        return F.when(pure.isNull(), a).when(~pure & inside, longer).when(~pure & begins, fresh).otherwise(outside)

    start = _row(first_page=_none("int"), last_page=_none("int"), pages=F.lit(0), ruling=F.lit(False), found=_none(_BLOCK))
    return F.aggregate(sheets, start, step, closed)


def _last_block(sheets, back: int = 25, ahead: int = 5) -> Column:
    """last_ruling_block() of the pages of one document."""
    last_of = lambda test: F.array_max(F.transform(F.filter(sheets, test), lambda x: x["page_no"]))
    low, high = (F.element_at(sheets, i)["page_no"] for i in (1, -1))

    def around(r):
        opened = last_of(lambda x: x["opening"] & ~x["envelope"] & (x["page_no"] <= r))
        return _row(first_page=F.coalesce(F.when(opened >= r - back, opened), r, low), last_page=F.coalesce(F.least(r + ahead, high), high))

    return F.transform(F.array(last_of(lambda x: x["ruling"])), around)[0]


def _decision_slice() -> Column:
    """The signed decision block, else the one by structure, else the surroundings of the last ruling, with its kind."""
    sheets = F.col("sheets")

    def named(b):
        within = lambda test: F.exists(sheets, lambda x: x["page_no"].between(b["first_page"], b["last_page"]) & test(x))
        appeal = F.coalesce(within(lambda x: x["appeal"]), F.lit(False)) & ~F.coalesce(within(lambda x: x["other"]), F.lit(False))
        return _row(kind=F.when(appeal, "appeal").otherwise("sentence"), first_page=b["first_page"], last_page=b["last_page"])

    return F.transform(F.array(F.coalesce(_signed_block(sheets), _built_block(sheets), _last_block(sheets))), named)[0]


def timeline(pages: DataFrame, catalog: Anchors = catalogs.ANCHORS, kinds: Sequence[tuple[str, str]] = catalogs.CONTENTS_KINDS) -> DataFrame:
    """(doc_id, kind, origin, first_page, last_page): pieces by contents; by anchors where a document has none; the decision by its pages where neither names one.

    Texts are written once and all that is read of them is read in one pass, of equal texts once. Then a document is a
    row with the flags and numbers of its pages, from which all of its pieces follow without a join.
    """
    found = {**_flags(catalogs.PAGE_FLAGS), **_anchor_marks(catalog), **_contents_marks(kinds)}
    texts = files.kept(pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text"), "pages")
    marks = items.with_shared_values(texts, "text", MANY, **found).select("doc_id", "page_no", *found)
    other = F.col("motion") | F.col("settlement") | F.col("order")
    headed, entries = _head(15)
    docs = _by_document(marks, "signed_on", "envelope", "opening", "ruling", "appeal", other.alias("other"), *_ends(catalog), entries, headed=headed, **_anchor_facts(catalog))
    piece = "array<struct<kind:string,first_page:int,last_page:int>>"
    by_contents = F.coalesce(F.when(F.col("headed"), _contents_slices(kinds, 8)), F.array().cast(piece)).alias("listed")
    docs = docs.select("*", by_contents).select("*", F.when(F.size("listed") == 0, _anchor_slices(catalog, 80, 30)).otherwise(F.array().cast(piece)).alias("anchored"))
    decided = F.exists(F.concat("listed", "anchored"), lambda x: x["kind"].isin("sentence", "appeal"))
    block = F.when(decided, F.array().cast(piece)).otherwise(F.array(_decision_slice()))
    with_origin = lambda slices, origin: F.transform(slices, lambda x: _row(kind=x["kind"], origin=F.lit(origin), first_page=x["first_page"], last_page=x["last_page"]))
    pieces = F.concat(with_origin("listed", "contents"), with_origin("anchored", "anchor"), with_origin(block, "block"))
    return _exploded(docs, pieces)
