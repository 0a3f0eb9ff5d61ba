"""Exact top-k search by inner product without random access (NRA), over blocks of candidates.

The integer vectors of a block make one list per dimension, sorted by component. A query reads the lists one after the other, those first where
its own components are largest. What a candidate has shown is its score so far; what it has not shown is bounded from both sides by the rest of
its norm times the rest of the query's norm (Cauchy-Schwarz), and by the ends of the lists not yet read. So every candidate has a lower and an
upper bound. The first list is read from its good end down to the frontier where no candidate behind it, whatever it holds elsewhere, reaches the
k-th lower bound; those are never read at all. Of the later lists only the entries of candidates that still qualify are read: after each few lists
the k-th lower bound rises and the others go. When all lists are read, the survivors' scores are final.

The k-th lower bound doesn't start from nothing: a first pass finds each query's k-th score among a sample of candidates (a bound like any other: the
true k-th score is no lower, and nothing is dropped that could reach it). The sample is every `THINNED`th candidate or fewer, at most some `SAMPLE` of them;
the queries are dealt over copies of it, so no task meets them all.

Sums are of integers in float64 while they can't pass 2^53, else of Python integers, by the same steps; bounds are floats, widened by more than they can err.

Blocks: candidates are dealt into blocks of bounded size, once; each block's task holds its lists and streams the queries by, which come to every
block with their bound. That is the query set against all rows, in blocks, so work and traffic grow with both. Each task returns at most k rows a
query; the ranks of those meet in a window that Spark limits to k rows before the shuffle.

Vectors that are null, empty or hold null, NaN or infinite components take no part. Only vectors of the query's length are its candidates.
Ties go to the smaller vec_id, then to any order for repeated rows; a query's own id is never its result. No queries or no candidates: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, partitions, read, staged

#: Lists read before the candidates are looked over again.
TOGETHER = 6
#: The sample for the first bound: one of so many candidates, or fewer; so many at most; queries that meet one copy of it.
THINNED, SAMPLE, PER_COPY = 8, 4096, 256
WHOLE = 1 << 53


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the integer components; vectors that can't take part are gone."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0)).where(whole).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


class Block:
    """The sorted lists of a block of candidates. `read` counts the entries that queries have read, `held` those that reading all would take."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.by_list = np.ascontiguousarray(x.T)  # one row per dimension
        self.order = np.argsort(self.by_list, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.by_list, self.order, axis=1)
        self.floats = self.by_list.astype(np.float64)
        self.norms = np.einsum("ij,ij->j", self.floats, self.floats)
        self.largest = float(np.sqrt(self.norms.max()))
        self.peak = int(np.abs(x).max())
        self.read = self.held = 0

    def first_list(self, of: int, weight: int, rest: float, floor: float) -> np.ndarray:
        """The candidates of a list, from its good end down to the frontier behind which none reaches `floor`."""
        values, order = self.sorted[of], self.order[of]
        if not weight or floor == -np.inf:
            return order
        frontier = (floor - rest * self.largest) / weight
        frontier -= math.copysign(1 + 1e-9 * abs(frontier), weight)
        if weight > 0:
            return order[np.searchsorted(values, frontier, "left") :]
        return order[: np.searchsorted(values, frontier, "right")]

    def topk(self, me: int, q: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(candidate, score), the best first, of those that can reach `floor`, a lower bound of the k-th score. Candidates of the query's own id are left out."""
        d = len(q)
        exact = d * self.peak * int(np.abs(q).max()) >= WHOLE
        q, held = (q.astype(object), self.by_list) if exact else (q.astype(np.float64), self.floats)
        lists = np.argsort(-np.abs(q).astype(np.float64), kind="stable")
        weights = np.abs(q[lists]).astype(np.float64)
        rest = np.sqrt(np.append(np.cumsum((weights**2)[::-1])[::-1], 0.0)) * (1 + 1e-9)
        ends = np.maximum(np.abs(self.sorted[lists, 0]), np.abs(self.sorted[lists, -1])).astype(np.float64)
        ends = np.append(np.cumsum((weights * ends)[::-1])[::-1], 0.0)
        alive = self.first_list(lists[0], q[lists[0]], rest[1], floor)
        alive = np.sort(alive[self.ids[alive] != me])
        score, left = np.zeros(len(alive), q.dtype), self.norms[alive]
        self.held += d * len(self.ids)
        for at in range(0, d, TOGETHER):
            some = lists[at : at + TOGETHER]
            part = np.stack([held[i].take(alive) for i in some])
            self.read += part.size
            score = score + q[some] @ (part.astype(object) if exact else part)
            now = score.astype(np.float64)
            to = at + len(some)
            if to == d:
                break
            shown = part.astype(np.float64) if exact else part
            left = np.maximum(left - np.einsum("ij,ij->j", shown, shown), 0)
            slack = np.minimum(rest[to] * np.sqrt(left + 1e-9 * self.largest**2 + 1), ends[to]) + 1 + 1e-9 * np.abs(now)
            if len(alive) > k:
                floor = max(floor, np.partition(now - slack, len(alive) - k)[len(alive) - k])
            keep = now + slack >= floor
            alive, score, left = alive[keep], score[keep], left[keep]
        best = np.lexsort((self.ids[alive], -score))[:k] if not exact else sorted(range(len(alive)), key=lambda i: (-score[i], self.ids[alive[i]]))[:k]
        return [(int(self.ids[alive[i]]), int(score[i])) for i in best]


def _searched(vectors: DataFrame, queries: DataFrame, blocks: int, k: int, copied: bool = False) -> DataFrame:
    """query_id, x, vec_id, score: each query's k best of each block. vectors: vec_id, x; queries: query_id, x, floor.

    The vectors are dealt into blocks and every block meets all queries, or, if `copied`, the queries are dealt and every block holds all vectors."""
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int").alias("b")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    rows = vectors.select(every if copied else dealt("vec_id", F.hash("x"), F.monotonically_increasing_id()), F.lit(0).alias("role"), F.size("x").alias("d"), F.col("vec_id").alias("id"), "x", F.lit(None).cast("double").alias("floor"))
    rows = rows.unionByName(queries.select(dealt("query_id", F.hash("x")) if copied else every, F.lit(1).alias("role"), F.size("x").alias("d"), F.col("query_id").alias("id"), "x", "floor"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, parts, held = None, [], None
        for batch in batches:
            out = []
            for (b, d, role), some in batch.groupby(["b", "d", "role"], sort=False):
                if place != (b, d):
                    place, parts, held = (b, d), [], None
                if not role:
                    parts.append((some["id"].to_numpy(), np.stack(some["x"])))
                elif parts:
                    held = held or Block(*map(np.concatenate, zip(*parts, strict=True)))
                    for me, q, floor in zip(some["id"], some["x"], some["floor"], strict=True):
                        out += [(me, q, i, s) for i, s in held.topk(me, np.asarray(q), k, -np.inf if floor is None or floor != floor else floor)]
            yield pd.DataFrame(out, columns=["query_id", "x", "vec_id", "score"])

    return rows.repartition(min(blocks, 4 * partitions(vectors.sparkSession)), "b").sortWithinPartitions("b", "d", "role").mapInPandas(search, "query_id long, x array<long>, vec_id long, score long")


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. Both inputs: vec_id and x, integers; queries: distinct rows."""
    spark = vectors.sparkSession
    n = vectors.count()
    asked = queries.select(F.col("vec_id").alias("query_id"), "x")
    dealt = F.pmod(F.xxhash64("vec_id", F.hash("x"), F.monotonically_increasing_id(), F.lit(5)), F.lit(max(THINNED, n // SAMPLE)))
    with Scratch(spark) as stage:
        # the sample's k-th score is a floor; with fewer than k rows there is none
        first = _searched(vectors.where(dealt == 0), asked.withColumn("floor", F.lit(None).cast("double")), max(1, math.ceil(asked.count() / PER_COPY)), k, copied=True)
        floors = stage(first.groupBy("query_id", "x").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k))
        bounded = asked.join(floors, ["query_id", "x"], "left").select("query_id", "x", F.col("least").cast("double").alias("floor"))
        blocks = max(math.ceil(n / block), min(partitions(spark), math.ceil(n / 1024)), 1)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = _searched(vectors, bounded, blocks, k).select("query_id", "vec_id", "score")
        return staged(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings")).where(F.col("vec_id").isNotNull())
    return topk(vectors, vectors.where(F.col("vec_id") % 50 == 0).distinct())


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
