"""Training corpus pipeline: language, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causa import reach_workers
from causa.llm import decontam, langid, packing, pii, simhash
from causa.llm.common import saved, table, unused

#: Below this calibrated probability no language is told apart; texts in two languages stay.
LEAST_SCORE = 0.4
SHINGLE = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; those without a letter go. Without any label to learn from, all stay."""
    reach_workers(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.labels:
        return docs
    name = unused(docs, "found")
    found = docs.withColumn(name, langid.scorer(spark, model)(F.col("text").cast("string")))
    return found.where((F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, of several with that id the one with the
    smallest hash of its text, of rows equal in both the one with the smallest hash of all columns. Rows with one id
    in different groups each stay. Rows without an id can't be named and stay, but don't count for their group.
    """
    found = simhash.near_duplicates(docs, shingle=SHINGLE).where("doc_id is not null")
    same = found.groupBy("root", "doc_id", "own").agg(F.count(F.lit(1)).alias("rows"))
    first = saved(same.groupBy("root").agg(F.min(F.struct("doc_id", "own", "rows")).alias("first")).select("first.doc_id", "first.own", "first.rows"))
    own = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"))
    alone, again = (rows.join(first.where(n), ["doc_id", "own"], "left_semi") for n in ("rows = 1", "rows > 1"))
    again = again.groupBy("doc_id", "own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.select("row.*").unionByName(again.select("row.*")).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; texts that are null or have no word stay, as do all rows where there is no item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data and what reveals it replaced by marks; n_chars follows, null texts stay null."""
    names = docs.columns
    clean = pii.sanitise(docs)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document; a null or empty text is one piece, repeated rows give repeated pieces."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL has no language model, SimHash components or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
