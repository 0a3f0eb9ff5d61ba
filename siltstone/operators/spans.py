"""Spans of texts: the line of an offset, spans cut at line ends, runs of a line between spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def by_line(spans: DataFrame) -> DataFrame:
    """id, line, start, end: spans (id, text, start, end) cut at line ends, in columns of each line; empty parts go."""
    lines = spans.select("id", "start", "end", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    order = Window.partitionBy("id", "start", "end").orderBy("at")
    first = F.coalesce(F.sum(F.length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("first", first).withColumn("from", F.greatest(F.col("start") - F.col("first"), F.lit(0))).withColumn("to", F.least(F.col("end") - F.col("first"), F.length("content")))
    return rows.where(F.col("from") < F.col("to")).select("id", (F.col("at") + 1).alias("line"), F.col("from").alias("start"), F.col("to").alias("end"))
