"""Evaluation queries: grades from passages and labels, nDCG, comparison, pooling, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation, graph, lexical
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.plans.search import documents, heads, indexed, queries_of
from siltstone.sources.tables import table

SMALL_K = 10


def graded(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    """Grades of the found pairs: by the document's label (quality 1 gives 1, else 0), then 3 where the document holds the whole passage."""
    pairs = found.select("query_id", "id").distinct()
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("grade"))
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    texts = documents(spark, sf).join(pairs.select("id").distinct(), "id", "left_semi")  # few ids: other texts stay where they are
    whole = pairs.join(passages, "query_id").join(texts, "id").where(F.col("text").contains(F.col("passage")))
    return evaluation.merged_grades(pairs.join(labels, "id"), whole.select("query_id", "id", F.lit(3).alias("grade")))


def both(spark: SparkSession, sf: str, limit: int) -> list[DataFrame]:
    q = queries_of(spark, sf)
    return [graph.saved(lexical.bm25(indexed(spark, sf, rows), q, limit)) for rows in (documents, heads)]


RANKINGS = f"{sql.bm25(limit=20, name='a')}, {sql.bm25(sql.HEADS, limit=20, name='b')}"
GRADES = """p AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM a UNION ALL SELECT query_id, id FROM b)),
g0 AS (SELECT query_id, id, max(quality) AS grade, 0 AS source FROM p JOIN labels ON doc_id = id GROUP BY query_id, id
 UNION ALL SELECT query_id, id, 3, 1 FROM p JOIN benchmark x ON item_id = query_id JOIN documents d ON d.doc_id = id WHERE contains(d.text, x.text)),
g AS (SELECT query_id, id, CAST(arg_max(grade, source) AS INTEGER) AS grade FROM g0 GROUP BY query_id, id)"""


def measured(r: str, name: str, k: int) -> str:
    return f"""{name}_i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM g) WHERE place <= {k} GROUP BY query_id HAVING ideal > 0),
{name}_f AS (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(grade) AS judged, count(*) AS results FROM {r} LEFT JOIN g USING (query_id, id) WHERE rank <= {k} GROUP BY query_id),
{name} AS (SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg, coalesce(judged, 0) AS judged, coalesce(results, 0) AS results FROM {name}_i LEFT JOIN {name}_f USING (query_id))"""


@query("assessments_merge", f"WITH {RANKINGS}, {GRADES} SELECT * FROM g")
def assessments_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    return graded(spark, sf, a.unionByName(b))


@query("ndcg_at_k", f"WITH {RANKINGS}, {GRADES}, {measured('a', 'm', SMALL_K)} SELECT * FROM m")
def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    return evaluation.measures(a, graded(spark, sf, a.unionByName(b)), SMALL_K)


KIND = "CAST(query_id % 4 AS VARCHAR) AS kind"


@query(
    "evaluate_by_kind",
    f"""WITH {RANKINGS}, {GRADES}, {measured('a', 'm3', 3)}, {measured('a', 'm10', 10)}, e AS (SELECT 3 AS k, *, {KIND} FROM m3 UNION ALL SELECT 10, *, {KIND} FROM m10)
 SELECT k, coalesce(kind, 'all') AS kind, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(coalesce(sum(judged)::DOUBLE / nullif(sum(results), 0), 1), 6) AS judged FROM e GROUP BY GROUPING SETS ((k, kind), (k))""",
)
def evaluate_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    grades = graph.saved(graded(spark, sf, a.unionByName(b)))
    kind = (F.col("query_id") % 4).cast("string")
    parts = [evaluation.by_kind(evaluation.measures(a, grades, k).withColumn("kind", kind)).select(F.lit(k).alias("k"), "*") for k in (3, 10)]
    return parts[0].unionByName(parts[1])


@query(
    "compare_pipelines",
    f"""WITH {RANKINGS}, {GRADES}, {measured('a', 'ma', 10)}, {measured('b', 'mb', 10)}, e AS (SELECT query_id, {KIND}, ma.ndcg AS b, mb.ndcg AS c FROM ma JOIN mb USING (query_id))
 SELECT coalesce(kind, 'all') AS kind, count(*) AS queries, round(avg(b), 6) AS baseline, round(avg(c), 6) AS candidate, count(*) FILTER (WHERE c > b) AS better, count(*) FILTER (WHERE c < b) AS worse FROM e GROUP BY ROLLUP (kind)""",
)
def compare_pipelines(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    grades = graph.saved(graded(spark, sf, a.unionByName(b)))
    of = lambda r: evaluation.measures(r, grades, 10).withColumn("kind", (F.col("query_id") % 4).cast("string"))
    return evaluation.compared(of(a), of(b))


@query("compare_interval")
def compare_interval(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    grades = graph.saved(graded(spark, sf, a.unionByName(b)))
    of = lambda r, name: evaluation.measures(r, grades, 10).select("query_id", F.col("ndcg").alias(name))
    rows = of(a, "x").join(of(b, "y"), "query_id").select((F.col("query_id") % 4).cast("string").alias("kind"), (F.col("y") - F.col("x")).alias("difference"))
    return evaluation.interval(rows, "kind")


POINT = "('0x' || substr(sha256(o_orderkey || ':' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "poisson_interval",
    f"""WITH r AS (SELECT o_orderpriority AS priority, o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, unnest(range(0, 20)) AS s FROM orders),
 w AS (SELECT priority, s, x, {' + '.join(f'CASE WHEN {POINT} >= {t!r}::DOUBLE THEN 1 ELSE 0 END' for t in evaluation._AT_MOST)} AS n FROM r),
 m AS (SELECT priority, s, sum(n * x) / sum(n) AS mean FROM w WHERE n > 0 GROUP BY priority, s)
 SELECT priority, round(quantile_cont(mean, 0.025), 2) AS low, round(quantile_cont(mean, 0.975), 2) AS high FROM m GROUP BY priority""",
)
def poisson_interval(spark: SparkSession, sf: str) -> DataFrame:
    """An interval of the mean price by priority, of 20 resamples: a group is a fifth of all orders."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", F.col("o_totalprice").cast("double").alias("difference"))
    return evaluation.poisson_interval(rows, "priority", "o_orderkey", 20).select("priority", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query(
    "pool_union",
    f"""WITH {RANKINGS}, s AS (SELECT query_id, id, min(p * 1000 + rank) AS seen FROM (SELECT 0 AS p, * FROM a UNION ALL SELECT 1, * FROM b) WHERE rank <= 10 GROUP BY query_id, id)
 SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen) AS INTEGER) AS place FROM s""",
)
def pool_union(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pooled(both(spark, sf, 20), 10)


@query("query_folds", "SELECT item_id, CAST(('0x' || substr(sha256(text), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM benchmark")
def query_folds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.fold(F.col("text")).alias("fold"))


@query("grade_histogram", f"WITH {RANKINGS}, {GRADES} SELECT grade, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY grade")
def grade_histogram(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    n = graph.saved(graded(spark, sf, a.unionByName(b)).groupBy("grade").agg(F.count("*").alias("n")))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("grade", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # total: one row


@query(
    "query_problems",
    f"""WITH {RANKINGS}, {GRADES}, w AS (SELECT query_id, id, grade FROM g UNION ALL SELECT query_id, id + 1000000000, grade FROM g WHERE id % 50 = 0)
 SELECT query_id, 'unknown id ' || id AS problem FROM w WHERE id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT query_id, 'two grades for ' || id FROM w GROUP BY query_id, id HAVING count(DISTINCT grade) > 1 UNION ALL SELECT query_id, 'no grade 3' FROM w GROUP BY query_id HAVING max(grade) < 3""",
)
def query_problems(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf, 20)
    g = graph.saved(graded(spark, sf, a.unionByName(b)))
    wrong = g.where(F.col("id") % 50 == 0).withColumn("id", F.col("id") + 1_000_000_000)
    return evaluation.problems(g.unionByName(wrong), documents(spark, sf))
