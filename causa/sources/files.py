"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that are read of an XML file; others are read whole.
LONGEST = 120_000
#: Suffix of a file to its character set; others are read as UTF-8.
CHARSETS = {"xml": "UTF-8", "txt": "UTF-8", "html": "UTF-8", "csv": "ISO-8859-1"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.causa.scratch", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, text) of the files of a folder: decoded by suffix, Latin-1 where UTF-8 doesn't fit."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    latin = F.decode("content", "ISO-8859-1")
    text = F.when(suffix.isin(*(k for k, v in CHARSETS.items() if v != "UTF-8")), latin).when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(latin)
    return raw.select("path", suffix.alias("suffix"), F.when(suffix == "xml", F.substring(text, 1, LONGEST)).otherwise(text).alias("text"))


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def write_runs(rows: DataFrame, path: str, by: str = "dt") -> None:
    """Audit records, nested, in a folder per day."""
    rows.write.mode("append").partitionBy(by).json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """A flat sheet: nested columns as JSON text."""
    nested = [f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")]
    rows.withColumns({n: F.to_json(n) for n in nested}).write.mode("overwrite").option("header", "true").csv(path)
