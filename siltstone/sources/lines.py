"""Lines of text files with their numbers, for files that are read in many splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and content of every line below a path.

    A split knows its file and where it begins; its lines are numbered inside by the order of reading. What lies before it in the file is the sum of
    the counts of the splits before, a few numbers a split, so no file is read by one task.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("content"), F.monotonically_increasing_id().alias("read"))
    splits = rows.groupBy("file", "split").agg(F.min("read").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("offset"))
    return rows.join(offsets, ["file", "split"]).select("file", (F.col("read") + F.col("offset")).alias("line"), "content")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line, `row` and `problem` of every line that isn't blank: a row by the schema, or what is wrong with the line."""
    lines = numbered(spark, path).where(F.trim("content") != "")
    read = F.from_json("content", f"{schema}, _wrong string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"})
    found = lines.withColumn("read", read)
    good = F.col("read").isNotNull() & F.col("read._wrong").isNull() & F.trim("content").startswith("{") & F.try_parse_json("content").isNotNull()
    return found.select("file", "line", F.when(good, F.col("read").dropFields("_wrong")).alias("row"), F.when(~good, F.concat(F.lit("line "), "line", F.lit(": not a record"))).alias("problem"))
