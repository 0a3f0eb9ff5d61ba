"""Queries that learn to rank: one round's gradients, and rankings by models of folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import features, graph, learned, lexical, pairwise
from siltstone.plans import sql
from siltstone.plans.assessment import both, graded
from siltstone.plans.registry import query
from siltstone.plans.search import documents, head_overlaps, indexed, queries_of

LEXICAL = ["body", "place", "head", "overlap", "log_length"]
#: Beside each lexical feature, how far it lies below the query's best, and its z-score in the query.
RELATIVE = [f"{c}{s}" for c in LEXICAL for s in ("", "_gap", "_z")]


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, id, fold, grade and the lexical features of every query's 50 candidates."""
    a, b = both(spark, sf, 50)
    found = a.select("query_id", "id", F.col("score").alias("body"), (1 / F.col("rank")).alias("place"))
    found = found.join(b.select("query_id", "id", F.col("score").alias("head")), ["query_id", "id"], "left").fillna(0.0, ["head"])
    found = found.join(head_overlaps(spark, sf, a).select("query_id", "id", F.col("score").alias("overlap")), ["query_id", "id"])
    found = found.join(graded(spark, sf, a), ["query_id", "id"], "left").join(documents(spark, sf).select("id", F.log1p(F.length("text")).alias("log_length")), "id")
    return found.join(queries_of(spark, sf).select("query_id", T.fold(F.col("text")).alias("fold")), "query_id")


@query("learned_rank")
def learned_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates ranked by folds of queries, by regression on the gain."""
    return learned.cross_ranked(graph.saved(examples(spark, sf)), LEXICAL)


def widened(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", "fold", "grade", *[x for c in LEXICAL for x in (F.col(c), features.gap(c, "query_id").alias(f"{c}_gap"), features.standardised(c, "query_id").alias(f"{c}_z"))])


@query("pairwise_rank")
def pairwise_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates ranked by folds of queries, by 20 rounds of trees on the gradients of pairs."""
    return pairwise.cross_ranked(widened(graph.saved(examples(spark, sf))), RELATIVE, rounds=20, least=20)


GRADIENTS = f"""WITH {sql.bm25(limit=50, name='a')}, g0 AS (SELECT query_id, id, max(quality) AS grade, 0 AS source FROM a JOIN labels ON doc_id = id GROUP BY query_id, id
 UNION ALL SELECT query_id, id, 3, 1 FROM a JOIN benchmark x ON item_id = query_id JOIN documents d ON d.doc_id = id WHERE contains(d.text, x.text)),
g AS (SELECT query_id, id, arg_max(grade, source) AS grade FROM g0 GROUP BY query_id, id),
c AS (SELECT query_id, id, score, coalesce(grade, 0) AS grade, rank - 1 AS place, pow(2, coalesce(grade, 0)) - 1 AS gain FROM a LEFT JOIN g USING (query_id, id)),
i AS (SELECT query_id, sum(gain / log2(best + 1)) AS ideal FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, id) AS best FROM c) GROUP BY query_id),
p AS (SELECT x.query_id, x.id AS up, y.id AS down, abs((x.gain - y.gain) * (1 / log2(x.place + 2) - 1 / log2(y.place + 2))) / ideal AS change, 1 / (1 + exp(x.score - y.score)) AS wrong
  FROM c x JOIN c y ON x.query_id = y.query_id AND x.grade > y.grade AND least(x.place, y.place) < 20 JOIN i ON i.query_id = x.query_id),
e AS (SELECT query_id, up AS id, change * wrong AS push, change * wrong * (1 - wrong) AS curve FROM p UNION ALL SELECT query_id, down, -change * wrong, change * wrong * (1 - wrong) FROM p)
SELECT query_id, id, round(coalesce(sum(push), 0), 6) + 0 AS push, round(coalesce(sum(curve), 0), 6) AS curve FROM c LEFT JOIN e USING (query_id, id) GROUP BY query_id, id"""


@query("pair_gradients", GRADIENTS)
def pair_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """The gradients of one round, from the scores of BM25."""
    found = graph.saved(lexical.bm25(indexed(spark, sf, documents), queries_of(spark, sf), 50))
    rows = found.join(graded(spark, sf, found), ["query_id", "id"], "left").select("query_id", "id", "score", F.coalesce("grade", F.lit(0)).alias("grade"))
    return pairwise.pair_gradients(rows).select("query_id", "id", (F.round("push", 6) + 0.0).alias("push"), F.round("curve", 6).alias("curve"))
