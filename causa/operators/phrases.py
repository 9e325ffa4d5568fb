"""Keys of texts by a catalog of phrases that is a table, however many phrases it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causa.functions import text
from causa.sources import files

#: Letters of a gram; shorter phrases are met as whole words.
GRAM = 4


def grams(c: Column, n: int = GRAM) -> Column:
    """Distinct stretches of n code points; none where the text is shorter. Letters are split once, as to take a
    stretch by its place reads a text from its start."""
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*(F.get(x, i + k) for k in range(n))))
    found = F.transform(F.array(F.split(c, "")), lambda x: F.when(F.size(x) >= n, pieces(x)))[0]
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def candidates(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, rank) pairs of which one may hold the other, without a pair lost.

    A text that holds a phrase holds the phrase's rarest gram, so each phrase has one entry. A phrase that holds a text
    holds all of its grams, so only texts whose grams the catalog knows are left, with one entry each. Phrases shorter
    than a gram are joined as words. The grams of texts are cut once; those that no phrase has go before they are written.
    texts: id, plain, grams; catalog: rank, phrase, grams.
    """
    phrase_grams = catalog.select("rank", F.explode("grams").alias("gram"))
    in_catalog = phrase_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    cut = texts.select("id", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    known = files.kept(cut.join(in_catalog, "gram"), "grams")
    in_texts = known.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    own = phrase_grams.join(in_texts, "gram", "left")  # a gram that no text has comes first, and its phrase meets none
    entry = own.groupBy("rank").agg(F.min_by("gram", F.struct(F.coalesce("uses", F.lit(0)), "gram")).alias("gram"))
    holding = known.join(entry, "gram").select("id", "rank")
    whole = known.groupBy("id", "all").agg(F.count(F.lit(1)).alias("had"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where(F.col("had") == F.col("all"))
    held = whole.join(phrase_grams, "gram").select("id", "rank")
    short = catalog.where(F.length("phrase") < GRAM).select("rank", F.col("phrase").alias("word"))
    words = texts.select("id", F.explode(F.array_distinct(F.split("plain", " "))).alias("word")).join(short, "word").select("id", "rank")
    pair = short.where("word like '% %'").select("rank", F.element_at(F.split("word", " "), 1).alias("word"))
    spaced = texts.select("id", F.explode(F.array_distinct(F.split("plain", " "))).alias("word")).join(pair, "word").select("id", "rank")
    return holding.unionByName(held).unionByName(words).unionByName(spaced).distinct()


def by_words(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, rank) pairs of texts and phrases of three words or more that they may hold, without a pair lost.

    A text that holds such a phrase has each of its inner words whole, so each phrase has one entry, under the rarest.
    texts: id, plain; catalog: rank, phrase.
    """
    split = F.split("phrase", " ")
    inner = catalog.select("rank", F.explode(F.array_distinct(F.slice(split, F.lit(2), F.size(split) - 2))).alias("word"))
    had = texts.select("id", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    known = files.kept(had.join(inner.select("word").distinct(), "word", "left_semi"), "words")
    uses = known.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    entry = inner.join(uses, "word", "left").groupBy("rank").agg(F.min_by("word", F.struct(F.coalesce("uses", F.lit(0)), "word")).alias("word"))
    return known.join(entry, "word").select("id", "rank")


def keys(rows: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """(plain, rank, key): for each different normalised text the phrase equal to it, else the first in rank that it
    holds or that holds it; texts without one have no row. As `text.phrase_key`, for catalogs of any size.

    catalog: rank (distinct), phrase, key. Phrases under four letters match whole words only, texts under four letters
    are held by no phrase. Nulls and empty phrases or texts match nothing; of equal phrases the first in rank counts.
    Phrases of three words or more are met by a whole inner word, others by grams.
    Texts stay out of these exchanges: they go by a hash of 128 bits, and join again where a candidate is.
    """
    plain = rows.select(text.norm_text(F.col(column)).alias("plain")).where("plain <> ''").distinct()
    texts = files.kept(plain.select(F.md5("plain").alias("id"), "plain"), "texts")
    known = catalog.select("rank", "key", text.norm_text(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    first = known.groupBy("phrase").agg(F.min_by(F.struct("rank", "key"), "rank").alias("f")).select("phrase", "f.*")
    first = files.kept(first, "phrases")
    gram_of = lambda t, c: t.withColumn("grams", grams(F.col(c)))
    many = F.size(F.split("phrase", " ")) >= 3
    longest = first.agg(F.max(F.length("phrase"))).first()[0] or 0
    # a phrase holds no text longer than itself, so grams are cut of long texts only for phrases without an inner word
    found = candidates(gram_of(texts.where(F.length("plain") <= longest), "plain"), gram_of(first, "phrase")).unionByName(by_words(texts, first.where(many)))
    if not first.where(~many).isEmpty():
        found = found.unionByName(candidates(gram_of(texts.where(F.length("plain") > longest), "plain"), gram_of(first.where(~many), "phrase")))
    found = found.distinct()
    whole = F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    inside = F.when(F.length("phrase") < GRAM, whole).otherwise(F.contains("plain", "phrase")) | ((F.length("plain") >= GRAM) & F.contains("phrase", "plain"))
    near = found.join(texts, "id").join(first, "rank").where(inside).select("plain", "rank", "key", F.lit(1).alias("far"))
    same = texts.join(first, F.col("plain") == F.col("phrase")).select("plain", "rank", "key", F.lit(0).alias("far"))
    best = near.unionByName(same).groupBy("plain").agg(F.min_by(F.struct("rank", "key"), F.struct("far", "rank")).alias("b"))
    return best.select("plain", "b.*")
