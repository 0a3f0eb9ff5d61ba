"""Names, versions and releases: the newest by version order, the next older one, states and status counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by the order, one shuffle, no sort of the whole table."""
    columns = [c for c in rows.columns if c not in keys]
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select(*keys, *columns)


def next_older(rows: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """For each row the ident of the row just before it, of its key, in the order (ties by ident)."""
    return rows.withColumn("older", F.lag(ident).over(Window.partitionBy(key).orderBy(order, ident)))


def state(invalid: Column, indexed: Column) -> Column:
    return F.when(invalid, "invalid").when(indexed, "indexed").otherwise("unindexed")


def status_counts(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row per key with the number of rows of each kind."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of rows in order, with the number of all rows in `total`. The total is an aggregate of its own, so only the page is sorted out."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total: one row


def within_budget(rows: DataFrame, group: str, order: list[Column | str], size: str, budget: int) -> DataFrame:
    """The rows of each group that are taken, in order, while their sizes stay within the budget; one that doesn't fit is passed over, and later ones still come.

    Groups stream by in order and only a total is carried, so a group of any length needs one batch of memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = None, 0
        for batch in batches:
            kept = []
            for g, n in zip(batch[group], batch[size], strict=True):
                if g != own:
                    own, total = g, 0
                kept.append(total + n <= budget)
                total += n if kept[-1] else 0
            yield batch[kept]

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(fold, rows.schema)
