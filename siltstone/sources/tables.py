"""Reading the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; Catalyst pushes columns and filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
