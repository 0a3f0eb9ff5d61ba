"""An index of vectors by cells, and searches in a scope: only the files of probed cells, and of cells that hold something of the scope, are read.

Cells. Centroids are fitted on a bounded sample, by hash, by rounds of assignment and means; every vector is then written to the folder of its nearest
one, sorted by id. A search takes each query's `probes` nearest cells, reads those folders alone and scores their vectors exactly.

Scope. The payload index has, for each key, the ids that hold it by cell. The ids of several keys are intersected before any vector is read; what
is left says which cells to read, and rows of other ids go before they are scored. With a scope every cell that holds an id of it is read, so the
result is exact.

Queries of `search` are few and stated, at most MOST, an error beyond; `search_many` takes any number: in a scope they meet its vectors by blocks and
parts, else each meets its cells', a group a cell or part of one and block of queries. Centroids are at most as many as the square root of the vectors, up to CELLS. Null
vectors aren't indexed. Equal scores go by id. A key that nothing has leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.operators import dense
from siltstone.operators.graph import saved, shared
from siltstone.operators.lexical import ranked

CELLS, SAMPLE, ROUNDS, MOST = 1024, 20_000, 8, 1000


def _with_cell(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("cell", IntegerType())])


@dataclass(frozen=True)
class Cells:
    """The folder of the vectors (id, v, by cell), the centroids, and the payload index (key, cell, ids)."""

    folder: str
    centroids: np.ndarray
    payload: DataFrame | None

    def vectors(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.schema(_with_cell(like.select("id", "v"))).parquet(self.folder)


def centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Means of the sample's vectors by their nearest mean, from an even choice of the sample on. A cell that nothing is nearest to keeps its place."""
    total = vectors.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20)) + 1
    some = vectors.where(share).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(some):
        return np.zeros((0, 0))
    x = np.stack(some["v"]).astype(float)
    means = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        nearest = (x @ means.T - (means**2).sum(1) / 2).argmax(1)
        for c in np.unique(nearest):
            means[c] = x[nearest == c].mean(0)
    return means


def _nearest(x: np.ndarray, means: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ means.T - (means**2).sum(1) / 2), axis=1, kind="stable")[:, :n]


def built(vectors: DataFrame, payload: DataFrame | None = None, cells: int | None = None) -> Cells:
    """The index of vectors (id, v; of length 1 and one dimension) and of their payload (id, key), written to the shared folder."""
    spark, rows = vectors.sparkSession, vectors.where("v is not null").select("id", "v")
    means = centroids(rows, cells or max(1, min(CELLS, int(rows.count() ** 0.5))))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=_nearest(np.stack(batch["v"]), means, 1)[:, 0].astype("int32"))

    found = rows.mapInPandas(placed, _with_cell(rows)) if len(means) else rows.withColumn("cell", F.lit(0))
    folder = f"{shared(spark)}/cells/{uuid.uuid4().hex}"
    # a cell is dealt to several tasks by id, so a cell that holds a large share of all vectors is several files
    found.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(folder)
    index = Cells(folder, means, None)
    if payload is None:
        return index
    held = payload.select("id", "key").distinct().join(index.vectors(vectors).select("id", "cell"), "id")
    postings = held.groupBy("key", "cell", F.pmod(F.xxhash64("id"), F.lit(64)).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return Cells(folder, means, saved(postings.repartition("key").sortWithinPartitions("key", "cell")))


def scope(index: Cells, keys: list) -> DataFrame:
    """id and cell of what holds all of the keys."""
    some = index.payload.where(F.col("key").isin(keys)).select("key", "cell", F.explode("ids").alias("id"))
    return some.groupBy("id", "cell").agg(F.count("*").alias("n")).where(F.col("n") == len(set(keys))).select("id", "cell")


def scoped(index: Cells, rows: DataFrame, keys: list | None, ids: DataFrame | None) -> DataFrame:
    """The vectors (rows: id, v, cell) that have all keys and one of the ids, of the cells that hold something of that scope alone."""
    within = scope(index, keys) if keys else None
    if ids is not None:
        own = rows.select("id", "cell").join(ids.select("id").distinct(), "id", "left_semi")
        within = own if within is None else within.join(own, ["id", "cell"], "left_semi")
    within = saved(within)
    wanted = sorted(r["cell"] for r in within.select("cell").distinct().collect())  # at most CELLS
    return rows.where(F.col("cell").isin(wanted)).join(within.select("id"), "id", "left_semi")


def search(index: Cells, like: DataFrame, queries: DataFrame, limit: int = 10, probes: int = 8, keys: list | None = None, ids: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score of the nearest by cosine; exact with `keys` or `ids` (id), else among the probed cells. like: a table of the vectors' columns; queries: query_id, q."""
    asked = queries.select("query_id", "q").limit(MOST + 1).collect()
    if len(asked) > MOST:
        raise ValueError(f"more than {MOST} queries")
    rows = index.vectors(like)
    names, matrix = [r["query_id"] for r in asked], np.array([r["q"] for r in asked], float)
    every = list(range(len(index.centroids)))
    if keys or ids is not None:
        rows = scoped(index, rows, keys, ids)
        of = {c: list(range(len(names))) for c in every or [0]}
    else:
        near = _nearest(matrix, index.centroids, probes) if len(names) and every else np.zeros((0, 0), int)
        of = {c: np.flatnonzero((near == c).any(1)).tolist() for c in every}
        of = {c: q for c, q in of.items() if q}
        rows = rows.where(F.col("cell").isin(sorted(of)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                part = part.sort_values("id", kind="stable")
                own = of[int(cell)]
                scores = np.round(np.stack(part["v"]) @ matrix[own].T, 6)
                order = np.argsort(-scores, axis=0, kind="stable")[:limit]
                found = part["id"].to_numpy()
                yield pd.concat([pd.DataFrame({"query_id": [names[q]] * len(order), "id": found[order[:, i]], "score": scores[order[:, i], i]}) for i, q in enumerate(own)])

    types = {f.name: f.dataType.simpleString() for f in [*like.schema.fields, *queries.schema.fields]}
    found = rows.select("id", "v", "cell").mapInPandas(best, f"query_id {types['query_id']}, id {types['id']}, score double")
    return ranked(found, limit).select("query_id", "rank", "id", "score")


def search_many(index: Cells, like: DataFrame, queries: DataFrame, limit: int = 10, probes: int = 8, keys: list | None = None, ids: DataFrame | None = None) -> DataFrame:
    """What `search` gives, for any number of queries; without a scope beyond MOST, queries and vectors of a cell meet by shuffles."""
    if keys or ids is not None:
        return dense.search(scoped(index, index.vectors(like), keys, ids), queries, limit)
    if queries.limit(MOST + 1).count() <= MOST:
        return search(index, like, queries, limit, probes)
    rows, means = index.vectors(like).select("id", "v", "cell"), index.centroids
    types = {f.name: f.dataType.simpleString() for f in [*like.schema.fields, *queries.schema.fields]}

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(means):
                yield batch.assign(cells=list(_nearest(dense.stacked(batch, "q"), means, probes).astype("int32")))

    asked = queries.where("q is not null").select("query_id", "q")
    placed = asked.mapInPandas(near, f"query_id {types['query_id']}, q {types['q']}, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))
    blocks = -(-queries.count() // dense.QUERY_BLOCK)
    # cells: at most CELLS rows
    parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / dense.VECTOR_PART).alias("parts")))
    group = (F.col("cell").cast("long") * (1 << 20) + F.col("part")).alias("_p")
    left = rows.join(parts, "cell").withColumns({"_b": dense.every(blocks), "part": F.pmod(F.xxhash64("id"), "parts")}).select("id", "v", "_b", group)
    right = placed.join(parts, "cell").withColumns({"_b": dense.part_of("query_id", blocks), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))})
    right = right.select("query_id", "q", "_b", group)
    found = dense.met(left, right, limit, f"query_id {types['query_id']}, id {types['id']}, score double")
    return ranked(found, limit).select("query_id", "rank", "id", "score")
