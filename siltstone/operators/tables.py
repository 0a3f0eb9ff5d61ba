"""Changes to tables as functions of snapshots: insert if absent, last write wins, generations, and what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it doesn't have; of rows with one key, one."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("last")).select(*keys, "last.*")


def promoted(generations: DataFrame, corpus: str, order: str, ready: Column) -> DataFrame:
    """Adds state: the newest ready generation of a corpus is live, older ones are retired, newer ones building."""
    newest = F.max(F.when(ready, F.col(order))).over(Window.partitionBy(corpus))
    state = F.when(F.col(order) == newest, "live").when(F.col(order) < newest, "retired").otherwise("building")
    return generations.withColumn("state", state)


def differing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, here, there: the keys whose numbers of rows differ between two tables."""
    a = left.groupBy(key).agg(F.count("*").alias("here"))
    b = right.groupBy(key).agg(F.count("*").alias("there"))
    return a.join(b, key, "full").select(key, F.coalesce("here", F.lit(0)).alias("here"), F.coalesce("there", F.lit(0)).alias("there")).where("here <> there")
