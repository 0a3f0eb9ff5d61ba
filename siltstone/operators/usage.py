"""The use graph's counts: who uses what, kept as users by key and as signed changes; filters by package, use and user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_counts(internal: DataFrame, external: DataFrame) -> DataFrame:
    """key, users: distinct internal users plus external users. internal: user, key; external: key, users."""
    inside = internal.distinct().groupBy("key").agg(F.count("*").alias("users"))
    return inside.unionByName(external.select("key", "users")).groupBy("key").agg(F.sum("users").cast("long").alias("users"))


def applied(counts: DataFrame, changes: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """Counts after signed changes (key, delta). Keys of `always` stay at 0; other keys at 0 go."""
    rows = counts.select("key", F.col("users").alias("delta")).unionByName(changes.select("key", "delta"))
    if always is not None:
        rows = rows.unionByName(always.select("key", F.lit(0).cast("long").alias("delta")))
    out = rows.groupBy("key").agg(F.sum("delta").cast("long").alias("users"))
    return out if always is not None else out.where(F.col("users") != 0)


def most_used(counts: DataFrame, limit: int = 50, *targets: DataFrame) -> DataFrame:
    """The keys with most users, ties by key, among those in every one of the targets (key): filters come before the limit."""
    for t in targets:
        counts = counts.join(t.select("key").distinct(), "key", "left_semi")
    return counts.orderBy(F.desc("users"), "key").limit(limit)
