"""File sources: lines, JSON lines, CSV with and without a header, JSON arrays and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of a file or directory."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``seq``, their order within each file.

    Splits of a file are ordered by their place in it, so the numbers follow
    from a count per split and no single task numbers all lines.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    from pyspark.sql import Window

    inside = Window.partitionBy("file", "block").orderBy("row")
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = raw.withColumn("at", F.row_number().over(inside)).join(offsets, ["file", "block"])
    return out.select((F.col("at") + F.col("offset") - 1).alias("seq"), "line", F.element_at(F.split("file", "/"), -1).alias("file"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines keep their text in ``_raw`` and null fields."""
    full = f"{schema}, _raw string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file that holds one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lookup(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """One file that holds one JSON object: a row per member."""
    whole = spark.read.option("wholetext", True).text(path)
    members = F.from_json("value", f"map<string, struct<{value_schema}>>")
    return whole.select(F.explode(members).alias(key, "_v")).select(key, "_v.*")


def rows(spark: SparkSession, items: list, schema: str) -> DataFrame:
    """In-memory rows, for tests."""
    return spark.createDataFrame(items, schema)
