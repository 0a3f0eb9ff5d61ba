"""Learned ranking with folds: each query is ranked by a model trained on the other folds.

Gradient boosted regression on the gain stands in for a pairwise ranking loss, which Spark doesn't have; scores are not comparable with it.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.evaluation import gain
from siltstone.operators.graph import saved
from siltstone.operators.lexical import ranked


def cross_ranked(candidates: DataFrame, features: list[str], folds: int = 5, rounds: int = 5, limit: int = 10, seed: int = 0) -> DataFrame:
    """candidates: query_id, id, fold, grade and the features. Each fold's queries are ranked by the model of the others."""
    candidates = saved(candidates)
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(candidates.withColumn("label", gain(F.coalesce("grade", F.lit(0)))))
    out = None
    for k in range(folds):
        others, own = assembled.where(F.col("fold") != k), assembled.where(F.col("fold") == k)
        if others.isEmpty():
            continue
        model = GBTRegressor(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=seed).fit(others)
        scored = model.transform(own).select("query_id", "id", F.round("prediction", 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return ranked(out, limit).select("query_id", "rank", "id", "score")
