"""Learning to rank from pairs: gradients of nDCG within each query, regression trees by histograms, models of folds trained together.

Gradients. Of two candidates of a query with different grades, at least one of them among the first TRUNCATION by score, the better is pushed up and the
other down by |change of nDCG if they swapped| / (1 + exp(difference of scores)); the second derivatives weigh the steps. The ideal is of the query's
own candidates. Pairs are within a query, whose candidates are as many as its depth.

Trees. Features are cut at quantiles into BINS. A tree grows level by level: a row is a query with its candidates; tasks score them by the trees so far, and send
sums of gradients by (model, node, feature, bin); Spark adds them, and the driver, which gets that many sums and no rows, picks each node's best split. Leaves
are Newton steps. So a round is DEPTH + 1 aggregates over one staged table, and nothing is rewritten between rounds but, every SAVED rounds, the scores.

Folds. The model of a fold learns from the queries of all others; all models grow in the same jobs. Each query is ranked by the model that hasn't
seen it. Query and feature subsets of a round are seeded, so a rerun gives the same trees.

Null or not finite features lie in the lowest bin. Null grades are 0. A query whose candidates have one grade teaches nothing. Ties of score keep the order of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.graph import saved
from siltstone.operators.lexical import ranked

#: Fixed values of the training that others compare with.
FOLDS, TRUNCATION, RATE, FEATURE_SHARE, QUERY_SHARE = 5, 20, 0.05, 0.8, 0.8
ROUNDS, DEPTH, BINS, LEAST_ROWS, RIDGE, SAVED = 100, 4, 32, 50, 1e-3, 25


def gradients(scores: np.ndarray, grades: np.ndarray, truncation: int = TRUNCATION) -> tuple[np.ndarray, np.ndarray]:
    """The push and the curvature of each candidate of one query, in order of preference for ties."""
    push, curve = np.zeros(len(scores)), np.zeros(len(scores))
    order = np.argsort(-scores, kind="stable")
    place = np.empty(len(scores), np.int64)
    place[order] = np.arange(len(scores))
    gain, discount = 2.0**grades - 1, 1 / np.log2(place + 2)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    i, j = np.nonzero((grades[:, None] > grades[None, :]) & (np.minimum(place[:, None], place[None, :]) < truncation))
    if ideal <= 0 or not len(i):
        return push, curve
    change = np.abs((gain[i] - gain[j]) * (discount[i] - discount[j])) / ideal
    wrong = 1 / (1 + np.exp(np.clip(scores[i] - scores[j], -50, 50)))
    for sums, at, value in ((push, i, change * wrong), (push, j, -change * wrong), (curve, i, change * wrong * (1 - wrong)), (curve, j, change * wrong * (1 - wrong))):
        np.add.at(sums, at, value)
    return push, curve


@dataclass
class Tree:
    """Nodes by level: the children of n are 2n + 1 and 2n + 2. feature -1: a leaf."""

    feature: np.ndarray = field(default_factory=lambda: np.full(2 ** (DEPTH + 1) - 1, -1))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(2 ** (DEPTH + 1) - 1, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(2 ** (DEPTH + 1) - 1))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            of = self.feature[at]
            inner = of >= 0
            right = bins[np.arange(len(bins)), np.maximum(of, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def cuts(candidates: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """The distinct quantiles that part each feature."""
    shares = [i / bins for i in range(1, bins)]
    found = candidates.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def binned(candidates: DataFrame, features: list[str], parts: list[list[float]]) -> DataFrame:
    """query_id, id, fold, grade and the features' bins as bytes; 0 where a feature isn't a number or lies below all cuts."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = np.zeros((len(batch), len(features)), np.uint8)
            for i, f in enumerate(features):
                x = batch[f].to_numpy(float)
                places[:, i] = np.where(np.isfinite(x), np.searchsorted(parts[i], np.nan_to_num(x)), 0)
            yield batch[["query_id", "id", "fold", "grade"]].assign(bins=[r.tobytes() for r in places])

    rows = candidates.select("query_id", "id", "fold", F.coalesce("grade", F.lit(0)).cast("double").alias("grade"), *[F.col(f).cast("double") for f in features])
    return rows.mapInPandas(one, f"query_id {candidates.schema['query_id'].dataType.simpleString()}, id {candidates.schema['id'].dataType.simpleString()}, fold int, grade double, bins binary")


def grouped(rows: DataFrame, folds: int) -> DataFrame:
    """A row for each query: its fold, and ids, grades, bins and the models' scores (one after another) of its candidates, which are as many as its depth."""
    own = F.array_sort(F.collect_list(F.struct("id", "grade", "bins")))
    found = rows.groupBy("query_id", "fold").agg(own.alias("c"))
    part = lambda name: F.transform("c", lambda x: x[name])
    return found.select("query_id", "fold", part("id").alias("ids"), part("grade").alias("grades"), F.array_join(F.transform("c", lambda x: F.hex(x["bins"])), "").alias("bins"), F.array_repeat(F.lit(0.0), F.size("c") * folds).alias("scores"))


def _matrix(bins: str, features: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(bins), np.uint8).reshape(-1, features)


def _unit(query: object, seed: int) -> float:
    """A number in [0, 1) of a query and a seed."""
    return zlib.crc32(f"{seed}/{query}".encode()) / 2.0**32


def _sums(models: list[list[Tree]], growing: list[Tree], wanted: list[list[int]], seed: int, count: int):
    """Sums of push, curvature and rows by (model, node, feature, bin), where `wanted` has each model's open nodes; feature -1: the node as a whole."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(models), 2 ** (DEPTH + 1) - 1, count, BINS, 3))
        for row in (r for batch in batches for r in batch.itertuples()):
            bins, grades = _matrix(row.bins, count), np.asarray(row.grades)
            if _unit(row.query_id, seed) >= QUERY_SHARE or grades.min() == grades.max():
                continue
            base = np.asarray(row.scores).reshape(len(models), len(bins))
            for k, trees in enumerate(models):
                if k == row.fold or not wanted[k]:
                    continue
                score = base[k].copy()
                for tree in trees:
                    score += tree.scores(bins)
                push, curve = gradients(score, grades)
                node = growing[k].nodes(bins)
                some = np.isin(node, wanted[k])
                for f in range(count):
                    np.add.at(held[k, :, f], (node[some], bins[some, f]), np.column_stack([push, curve, np.ones(len(push))])[some])
        at = np.argwhere(held[..., 2] > 0)
        yield pd.DataFrame({**{n: at[:, i] for i, n in enumerate(("model", "node", "feature", "bin"))}, **{n: held[(*at.T, i)] for i, n in enumerate(("push", "curve", "n"))}})

    return one


def _split(sums: np.ndarray, allowed: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and cut of a node's best split; sums: feature, bin, (push, curvature, rows)."""
    left = sums.cumsum(1)
    whole = left[:, -1:]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    gain = worth(left) + worth(right) - worth(whole)
    fits = (left[..., 2] >= least) & (right[..., 2] >= least) & allowed[:, None]
    gain = np.where(fits, gain, -1.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def trained(rows: DataFrame, features: int, folds: int = FOLDS, rounds: int = ROUNDS, rate: float = RATE, least: int = LEAST_ROWS, seed: int = 0) -> list[list[Tree]]:
    """The trees of each fold's model. rows: as `binned` gives them."""
    data, models, fresh = saved(grouped(rows, folds)), [[] for _ in range(folds)], [[] for _ in range(folds)]
    schema = "model int, node int, feature int, bin int, push double, curve double, n double"
    for step in range(rounds):
        growing = [Tree() for _ in range(folds)]
        draw = np.random.default_rng([seed, step])
        allowed = [np.isin(np.arange(features), draw.permutation(features)[: max(1, round(FEATURE_SHARE * features))]) for _ in range(folds)]
        wanted: list[list[int]] = [[0] for _ in range(folds)]
        for level in range(DEPTH + 1):
            if not any(wanted):
                break
            found = data.mapInPandas(_sums(fresh, growing, wanted, seed + 1000 * step, features), schema)
            table = found.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("push", "curve", "n")]).toPandas()
            sums = np.zeros((folds, 2 ** (DEPTH + 1) - 1, features, BINS, 3))
            at = tuple(table[c].to_numpy(np.int64) for c in ("model", "node", "feature", "bin"))
            sums[at] = table[["push", "curve", "n"]].to_numpy()
            following: list[list[int]] = [[] for _ in range(folds)]
            for k, tree in enumerate(growing):
                for node in wanted[k]:
                    whole = sums[k, node, 0].sum(0)
                    tree.value[node] = rate * whole[0] / (whole[1] + RIDGE) if whole[1] else 0.0
                    gain, f, b = _split(sums[k, node], allowed[k], least) if level < DEPTH else (0.0, 0, 0)
                    if gain > 1e-12:
                        tree.feature[node], tree.cut[node] = f, b
                        following[k] += [2 * node + 1, 2 * node + 2]
            wanted = following
        for k, tree in enumerate(growing):
            models[k].append(tree)
            fresh[k].append(tree)
        if (step + 1) % SAVED == 0 and step + 1 < rounds:
            data = saved(scored(data, fresh, features))
            fresh = [[] for _ in range(folds)]
    return models


def scored(data: DataFrame, models: list[list[Tree]], features: int) -> DataFrame:
    """Queries as `grouped` gives them, with what the models add to the scores."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for bins, before in zip(batch["bins"], batch["scores"], strict=True):
                own = _matrix(bins, features)
                more = np.stack([sum((t.scores(own) for t in trees), np.zeros(len(own))) for trees in models])
                out.append(np.asarray(before) + more.ravel())
            yield batch.assign(scores=out)

    return data.mapInPandas(one, data.schema)


def cross_ranked(candidates: DataFrame, features: list[str], folds: int = FOLDS, rounds: int = ROUNDS, limit: int = 10, least: int = LEAST_ROWS, seed: int = 0) -> DataFrame:
    """query_id, rank, id, score. candidates: query_id, id, fold, grade and the features; each fold's queries are ranked by the model of the others."""
    rows = saved(binned(candidates, features, cuts(candidates, features)))
    models = trained(rows, len(features), folds, rounds, least=least, seed=seed)
    found = scored(grouped(rows, folds), models, len(features))
    own = F.slice("scores", F.col("fold") * F.size("ids") + 1, F.size("ids"))  # the model that hasn't seen the query
    each = found.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("id"), own.alias("score"))).alias("x"))
    return ranked(each.select("query_id", F.col("x.id").alias("id"), F.round("x.score", 6).alias("score")), limit).select("query_id", "rank", "id", "score")


def pair_gradients(candidates: DataFrame, truncation: int = TRUNCATION) -> DataFrame:
    """query_id, id, push and curve of one round by built-in functions: candidates (query_id, id, score, grade) meet those of their own query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    gains = candidates.select("query_id", "id", "score", "grade", (F.row_number().over(order) - 1).alias("place"), (F.pow(F.lit(2.0), "grade") - 1).alias("gain"))
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")
    rows = gains.withColumn("discount", 1 / F.log2(F.col("place") + 2)).withColumn("best", F.row_number().over(best))
    rows = rows.withColumn("ideal", F.sum(F.col("gain") / F.log2(F.col("best") + 1)).over(Window.partitionBy("query_id")))
    a, b = rows.alias("a"), rows.alias("b")
    first = F.least(F.col("a.place"), F.col("b.place")) < truncation
    pairs = a.join(b, F.col("a.query_id") == F.col("b.query_id")).where((F.col("a.grade") > F.col("b.grade")) & first)
    change = F.abs((F.col("a.gain") - F.col("b.gain")) * (F.col("a.discount") - F.col("b.discount"))) / F.col("a.ideal")
    wrong = 1 / (1 + F.exp(F.col("a.score") - F.col("b.score")))
    both = pairs.select(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("up"), F.col("b.id").alias("down"), (change * wrong).alias("push"), (change * wrong * (1 - wrong)).alias("curve"))
    every = both.select("query_id", F.col("up").alias("id"), "push", "curve").unionByName(both.select("query_id", F.col("down").alias("id"), (-F.col("push")).alias("push"), "curve"))
    sums = every.groupBy("query_id", "id").agg(F.sum("push").alias("push"), F.sum("curve").alias("curve"))
    return candidates.select("query_id", "id").join(sums, ["query_id", "id"], "left").fillna(0.0, ["push", "curve"])
