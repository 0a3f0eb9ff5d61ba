"""Evaluation of rankings: grades, nDCG, judged shares, groups by kind, paired comparison with a bootstrap interval, pooling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the interval.
SAMPLES, SEED, LOW, HIGH = 10_000, 0, 0.025, 0.975


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def merged_grades(*sources: DataFrame) -> DataFrame:
    """query_id, id, grade; of several grades for a pair the one of the last source wins (within a source the highest)."""
    rows = None
    for i, s in enumerate(sources):
        own = s.select("query_id", "id", "grade", F.lit(i).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", "id").agg(F.max(F.struct("source", "grade"))["grade"].alias("grade"))


def measures(rankings: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Per query with a grade above 0: nDCG@k, judged and returned results. The ideal is of all known grades, ungraded results gain nothing."""
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = grades.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain(F.col("grade")) * discount(F.col("place"))).alias("ideal")).where(F.col("ideal") > 0)
    found = rankings.where(F.col("rank") <= k).join(grades, ["query_id", "id"], "left")
    found = found.groupBy("query_id").agg(
        F.sum(gain(F.coalesce("grade", F.lit(0))) * discount(F.col("rank"))).alias("dcg"), F.count("grade").alias("judged"), F.count("*").alias("results")
    )
    rows = ideal.join(found, "query_id", "left").fillna(0)
    return rows.select("query_id", F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"), "judged", "results")


def by_kind(measured: DataFrame) -> DataFrame:
    """measured: kind, ndcg, judged, results. One row per kind and one for `all`; no results count as judged whole."""
    rows = measured.rollup("kind").agg(
        F.count("*").alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.sum("judged").alias("j"), F.sum("results").alias("r")
    )
    return rows.select(F.coalesce("kind", F.lit("all")).alias("kind"), "queries", "ndcg", F.round(F.coalesce(F.col("j") / F.nullif("r", F.lit(0)), F.lit(1.0)), 6).alias("judged"))


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per kind and for `all`: means of both, better and worse. Both: query_id, kind, ndcg."""
    rows = baseline.select("query_id", "kind", F.col("ndcg").alias("b")).join(candidate.select("query_id", F.col("ndcg").alias("c")), "query_id")
    found = rows.rollup("kind").agg(
        F.count("*").alias("queries"),
        F.round(F.avg("b"), 6).alias("baseline"),
        F.round(F.avg("c"), 6).alias("candidate"),
        F.count_if(F.col("c") > F.col("b")).alias("better"),
        F.count_if(F.col("c") < F.col("b")).alias("worse"),
    )
    return found.withColumn("kind", F.coalesce("kind", F.lit("all")))


def interval(differences: DataFrame, by: str) -> DataFrame:
    """Bootstrap interval of the mean of `difference` in each group: 10,000 resamples with a fixed seed, linear quantiles.

    A group holds one number per judged query, so it is small beside any table; the resamples of a group are drawn in blocks.
    """

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        values = part["difference"].sort_values().to_numpy()
        random, means = np.random.default_rng(SEED), []
        step = max(1, 2_000_000 // len(values))
        for at in range(0, SAMPLES, step):
            means.append(values[random.integers(0, len(values), (min(step, SAMPLES - at), len(values)))].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [LOW, HIGH])
        return pd.DataFrame({by: [part[by].iloc[0]], "low": [low], "high": [high]})

    return differences.groupBy(by).applyInPandas(draw, f"{by} string, low double, high double")


#: Shares of at most 0, 1, 2, ... events where one is expected: sums of 1 / (e k!).
_AT_MOST = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def drawn(key: Column, sample: Column) -> Column:
    """How often a row is in a resample: a Poisson number of mean 1, from the first 32 bits of a digest of its key and the resample's number."""
    point = F.conv(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), sample.cast("string")), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return sum((F.when(point >= t, 1).otherwise(0) for t in _AT_MOST), F.lit(0))


def poisson_interval(differences: DataFrame, by: str, key: str, samples: int = 1000) -> DataFrame:
    """Bootstrap interval of the mean of `difference` in each group, for groups of any size.

    Each row draws for itself how often each resample has it, so resamples are sums: rows are multiplied only inside the task that reads them,
    and a row a group and resample is shuffled. Empty resamples have no mean and don't count. Reruns agree, whatever the partitions."""
    rows = differences.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("n", drawn(F.col(key), F.col("sample"))).where("n > 0")
    means = rows.groupBy(by, "sample").agg((F.sum(F.col("n") * F.col("difference")) / F.sum("n")).alias("mean"))
    return means.groupBy(by).agg(F.percentile("mean", F.lit(LOW)).alias("low"), F.percentile("mean", F.lit(HIGH)).alias("high"))


def pooled(rankings: list[DataFrame], depth: int) -> DataFrame:
    """query_id, id and place of every result of any ranking to a depth, first seen first, ranking by ranking."""
    rows = None
    for i, r in enumerate(rankings):
        own = r.where(F.col("rank") <= depth).select("query_id", "id", F.lit(i).alias("pipeline"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    seen = rows.groupBy("query_id", "id").agg(F.min(F.struct("pipeline", "rank")).alias("seen"))
    return seen.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("seen")).alias("place"))


def problems(grades: DataFrame, known: DataFrame) -> DataFrame:
    """query_id and problem: ids that no table knows, a pair with two grades, no grade 3."""
    unknown = grades.join(known.select("id"), "id", "left_anti").select("query_id", F.concat(F.lit("unknown id "), F.col("id").cast("string")).alias("problem"))
    twice = grades.groupBy("query_id", "id").agg(F.countDistinct("grade").alias("n")).where("n > 1")
    twice = twice.select("query_id", F.concat(F.lit("two grades for "), F.col("id").cast("string")).alias("problem"))
    none = grades.groupBy("query_id").agg(F.max("grade").alias("top")).where("top < 3").select("query_id", F.lit("no grade 3").alias("problem"))
    return unknown.unionByName(twice).unionByName(none)
