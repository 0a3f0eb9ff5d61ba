"""Dense retrieval: exact cosine top-k with filters before the rank, scores for given ids, coarse search with rescoring.

Queries are a stated set. At most `BROADCAST_QUERIES` of them are one matrix that Arrow batches of vectors are multiplied with; more are dealt out in
blocks of about `QUERY_BLOCK`, and each block meets each part of about `VECTOR_PART` vectors in a group of its own, so neither driver nor task holds all of
either. A search lets only each batch's or part's best on, so what is ranked grows with the parts, not with the pairs; its blocks have up to
`SEARCH_BLOCK` queries, since every block gets a copy of the vectors. Null vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators.lexical import ranked

BROADCAST_QUERIES, QUERY_BLOCK, SEARCH_BLOCK, VECTOR_PART = 1000, 1024, 8192, 8192
#: Queries whose scores of a batch leave a task in one frame.
OUT_BLOCK = 64


def every(n: int) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def part_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _matrix(queries: DataFrame) -> tuple[list, np.ndarray | None]:
    """The queries' ids and the matrix of their vectors; no matrix where they are too many for one."""
    asked = queries.select("query_id", "q").where("q is not null").limit(BROADCAST_QUERIES + 1).collect()
    return [r["query_id"] for r in asked], None if len(asked) > BROADCAST_QUERIES else np.array([r["q"] for r in asked], float).T


def best(names: list, matrix: np.ndarray, ids: np.ndarray, x: np.ndarray, kept: int | None) -> Iterator[pd.DataFrame]:
    """Frames of query_id, id, score: the best `kept` of each query (a column of the matrix) among vectors in order of their ids, or all. Ties go by id."""
    for start in range(0, len(names), OUT_BLOCK):
        own = names[start : start + OUT_BLOCK]
        scores = np.round(matrix[:, start : start + OUT_BLOCK].T @ x.T, 6) + 0.0
        if kept is None or kept >= len(ids):
            q, at = np.divmod(np.arange(scores.size), len(ids))
        else:
            q, at = np.nonzero(scores >= np.partition(scores, len(ids) - kept, axis=1)[:, [len(ids) - kept]])
            order = np.lexsort((at, -scores[q, at], q))
            q, at = q[order], at[order]
            some = np.arange(len(q)) - np.searchsorted(q, q) < kept
            q, at = q[some], at[some]
        yield pd.DataFrame({"query_id": pd.Series(own).to_numpy()[q], "id": ids[at], "score": scores[q, at]})


def stacked(part: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(part[column]).astype(float)


def block_of(kept: int | None) -> int:
    """Queries of a block: as many as leave a group no more rows than `QUERY_BLOCK` of them whose pairs are all wanted."""
    return QUERY_BLOCK if kept is None else max(QUERY_BLOCK, min(SEARCH_BLOCK, QUERY_BLOCK * VECTOR_PART // max(1, kept)))


def _scored(vectors: DataFrame, queries: DataFrame, kept: int | None) -> DataFrame:
    """query_id, id, score: of each Arrow batch or part of vectors the best `kept` of a query, or all."""
    rows, (names, matrix) = vectors.where(F.col("v").isNotNull()).select("id", "v"), _matrix(queries)
    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    schema = f"query_id {types['query_id']}, id {types['id']}, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and names:
                batch = batch.sort_values("id", kind="stable")
                yield from best(names, matrix, batch["id"].to_numpy(), stacked(batch, "v"), kept)

    if matrix is not None:
        return rows.mapInPandas(run, schema)
    asked = queries.where("q is not null").select("query_id", "q")
    blocks, parts = -(-asked.count() // block_of(kept)), max(1, -(-vectors.count() // VECTOR_PART))
    left = rows.withColumns({"_b": every(blocks), "_p": part_of("id", parts)})
    right = asked.withColumns({"_b": part_of("query_id", blocks), "_p": every(parts)})
    return met(left, right, kept, schema)


def met(left: DataFrame, right: DataFrame, kept: int | None, schema: str) -> DataFrame:
    """query_id, id, score within the groups of _b and _p: vectors (id, v) on the left, queries (query_id, q) on the right."""

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "id": own["id"][:0], "score": np.zeros(0)})
        own = own.sort_values("id", kind="stable")
        return pd.concat(best(asked["query_id"].tolist(), stacked(asked, "q").T, own["id"].to_numpy(), stacked(own, "v"), kept))

    # a number of partitions by bytes would be too few for the work of a group
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, "_b", "_p").groupBy("_b", "_p")
    return dealt(left).cogroup(dealt(right)).applyInPandas(run, schema)


def search(vectors: DataFrame, queries: DataFrame, limit: int = 10, where: Column | None = None) -> DataFrame:
    """The nearest by inner product, which is the cosine for vectors of length 1. vectors: id, v; queries: query_id, q; all of one dimension."""
    found = _scored(vectors if where is None else vectors.where(where), queries, limit)
    return ranked(found, limit).select("query_id", "rank", "id", "score")


def products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score of every query with every vector. As many rows as pairs: for those who want them all."""
    return _scored(vectors, queries, None)


def scores_for(vectors: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Exact scores of the given ids alone; absent ids give no row."""
    return products(vectors.join(ids.select("id").distinct(), "id", "left_semi"), queries)


def int8_search(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The best by whole-number products of int8 vectors, not rescored."""
    small = search(vectors.select("id", V.int8(F.col("v")).alias("v")), queries.select("query_id", V.int8(F.col("q")).alias("q")), limit)
    return small.withColumn("score", F.col("score").cast("int"))


def binary_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, oversampling: int = 2) -> DataFrame:
    """Coarse by signs, `oversampling` times as many, then exact: only those ids meet the vectors again. Products of signs rank as equal signs do."""
    signs = lambda c: F.transform(V.binary(F.col(c)), lambda b: 2 * b - 1)
    few = search(vectors.select("id", signs("v").alias("v")), queries.select("query_id", signs("q").alias("q")), limit * oversampling)
    near = few.select("query_id", "id").join(vectors.select("id", "v"), "id").join(queries.select("query_id", "q"), "query_id")
    return ranked(near.select("query_id", "id", F.round(V.dot(F.col("v"), F.col("q")), 6).alias("score")), limit).select("query_id", "rank", "id", "score")


def best_by(scores: DataFrame, key: str) -> DataFrame:
    """Adds the query's best score and count within each value of `key`."""
    group = Window.partitionBy("query_id", key)
    return scores.withColumn("best", F.max("score").over(group)).withColumn("count", F.count("*").over(group))
