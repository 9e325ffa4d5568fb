"""Fields that versions of nested JSON records have, found in the records themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causa.sources import files


def fields(records: DataFrame, json_col: str = "record", by: str = "version", deepest: int = 20) -> DataFrame:
    """(by, path, type, records): every path of every version, its types and the number of records that have it.

    Paths join the keys of objects with points and name the elements of an array `[]`; types are those of single values,
    ARRAY and OBJECT, several of one path joined by a bar. Records are opened level by level as variants, and each
    level is counted per path before the next; a text that is no JSON has the path `$` and the type INVALID, a null is
    left out. Opening ends where no record has another level, or below `deepest`.
    """
    spark = records.sparkSession
    value = F.try_parse_json(F.col(json_col))
    level = records.where(F.col(json_col).isNotNull()).select(F.col(by).alias("version"), F.xxhash64(F.monotonically_increasing_id()).alias("row"), F.lit("$").alias("path"), F.lit(False).alias("many"), value.alias("v"))
    kind = F.when(F.col("v").isNull(), "INVALID").otherwise(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
    found = None
    for _ in range(deepest):
        # opened once: it is counted, and opened again below; single values need not be written
        typed = level.withColumn("type", kind).withColumn("v", F.when(F.col("type").isin("OBJECT", "ARRAY"), F.col("v")))
        here = files.kept(typed, "level")
        # a record has a path once, but for those that lead through an array: only these are told apart by their records
        rows = here.groupBy("version", "path", "type", F.when(F.col("many"), F.col("row")).alias("row")).agg(F.count(F.lit(1)).alias("n"))
        each = rows.groupBy("version", "path", "type").agg(F.sum(F.when(F.col("row").isNull(), F.col("n")).otherwise(1)).alias("records"))
        found = each if found is None else found.unionByName(each)
        nested = here.where("v is not null").select("version", "row", "path", "many", "v")
        if nested.isEmpty():
            break
        inner = spark.sql("SELECT version, row, path, many, e.key, e.value FROM {nested} AS n, LATERAL variant_explode(n.v) AS e", nested=nested)
        step = F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select("version", "row", F.concat("path", step).alias("path"), (F.col("many") | F.col("key").isNull()).alias("many"), F.col("value").alias("v"))
    return found.groupBy("version", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"), F.max("records").alias("records")).select(F.col("version").alias(by), "path", "type", "records")


def diff(known: DataFrame, before, after, by: str = "version") -> DataFrame:
    """(path, change, before, after) of two versions of fields(): added, removed and retyped paths."""
    side = lambda v, n: known.where(F.col(by) == v).select("path", F.col("type").alias(n))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "retyped")
    return side(before, "before").join(side(after, "after"), "path", "full").withColumn("change", change).where("change is not null").select("path", "change", "before", "after")


def digests(known: DataFrame, by: str = "version") -> DataFrame:
    """(by, paths, digest): one hash per version, whatever the order of the fields in the records."""
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "type")))
    return known.groupBy(by).agg(F.count(F.lit(1)).alias("paths"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
