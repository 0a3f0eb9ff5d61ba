"""Queries on vectors by cells and in a scope. A vector's payload is the suppliers of the order of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import cells
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.plans.search import vector_queries, vectors
from siltstone.sources.tables import table

#: The share of cells that a query probes. The vectors have no structure: recall at 10 is 0.94 over 500 of them and 0.925 over 2,000.
PROBED = 0.6


def payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 10).alias("key"))


def scoped_sql(where: str) -> str:
    return f"WITH {sql.UNIT}, k AS (SELECT l_orderkey AS id, l_suppkey % 10 AS key FROM lineitem) " + sql.top(f"SELECT q.id AS query_id, n.id AS id, round(list_dot_product(n.v, q.v), 6) AS score FROM n, n q WHERE q.id % 100 = 0 AND {where}")


@query("cells_topk")
def cells_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate: exact scores of what lies in the probed cells; tests measure recall."""
    v = vectors(spark, sf)
    index = cells.built(v)
    return cells.search_many(index, v, vector_queries(spark, sf), probes=round(PROBED * len(index.centroids)))


@query("scoped_topk", scoped_sql("n.id IN (SELECT id FROM k WHERE key = 3) AND n.id IN (SELECT id FROM k WHERE key = 7)"))
def scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest among those whose payload has both keys."""
    v = vectors(spark, sf)
    return cells.search_many(cells.built(v, payload(spark, sf)), v, vector_queries(spark, sf), keys=[3, 7])


@query("scoped_ids_topk", scoped_sql("n.id IN (SELECT id FROM k WHERE key = 5) AND n.id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = \'F\')"))
def scoped_ids_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest among those whose payload has a key and whose ids another table gives."""
    v = vectors(spark, sf)
    ids = table(spark, sf, "orders").where("o_orderstatus = \'F\'").select(F.col("o_orderkey").alias("id"))
    return cells.search_many(cells.built(v, payload(spark, sf)), v, vector_queries(spark, sf), keys=[5], ids=ids)
