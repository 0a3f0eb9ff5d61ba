"""Retrieval queries: lexical, by name, dense, fused and reranked, and the ranking features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import dense, features, lexical
from siltstone.operators.graph import saved
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.sources.tables import table


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), F.substring_index("text", "\n", 1)).alias("text"))


_indexes: dict[tuple, lexical.Index] = {}


def indexed(spark: SparkSession, sf: str, rows) -> lexical.Index:
    """The index of documents or heads, built once a session for the files that the table has now."""
    docs = rows(spark, sf)
    key = (spark.sparkContext.applicationId, rows.__name__, *sorted(docs.inputFiles()))
    if key not in _indexes:
        _indexes[key] = lexical.index(docs)
    return _indexes[key]


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", V.normalised(V.doubles(F.col("embedding"))).alias("v"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@query("tokenize_documents", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY doc_id, term")
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_counts(documents(spark, sf)).select(F.col("id").alias("doc_id"), "term", "tf")


STOPWORDS = ("a", "an", "and", "are", "be", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")


@query(
    "singular_stems",
    f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({sql.tokens('text')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in STOPWORDS)}], t)), lambda t: {sql.singular('t')}))), ' ') AS stems FROM benchmark",
)
def singular_stems(spark: SparkSession, sf: str) -> DataFrame:
    stop = F.array(*map(F.lit, STOPWORDS))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.content_stems(F.col("text"), stop)), " ").alias("stems"))


@query("bm25_topk", f"WITH {sql.bm25()} SELECT * FROM bm25")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(indexed(spark, sf, documents), queries_of(spark, sf))


@query("bm25_head_topk", f"WITH {sql.bm25(sql.HEADS)} SELECT * FROM bm25")
def bm25_head_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(indexed(spark, sf, heads), queries_of(spark, sf))


NAME_QUERIES = "SELECT min(p_partkey) AS query_id, text FROM (SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ' ') AS text FROM part) GROUP BY text"


@query(
    "name_match",
    f"""WITH n AS (SELECT p_partkey AS id, list_distinct({sql.tokens('p_name')}) AS s FROM part), q AS (SELECT query_id, list_distinct({sql.tokens('text')}) AS a FROM ({NAME_QUERIES})),
 h AS (SELECT query_id, id, round(len(list_intersect(a, s))::DOUBLE / (len(a) + len(s) - len(list_intersect(a, s))), 6) AS score FROM n, q)
 {sql.top('SELECT * FROM h WHERE score >= 0.5')}""",
)
def name_match(spark: SparkSession, sf: str) -> DataFrame:
    first = names(spark, sf).select("id", F.element_at(F.split("text", " "), 1).alias("text"))
    return lexical.name_match(names(spark, sf), first.groupBy("text").agg(F.min("id").alias("query_id")))


FUSED = "SELECT query_id, id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score, min(pipeline * 1000 + rank) AS seen FROM (SELECT 0 AS pipeline, * FROM a UNION ALL SELECT 1, * FROM b) GROUP BY query_id, id"


@query("rrf_fusion", f"WITH {sql.bm25(limit=100, name='a')}, {sql.bm25(sql.HEADS, limit=100, name='b')} {sql.top(FUSED, 10, 'seen, id')}")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    q = queries_of(spark, sf)
    return lexical.fused([lexical.bm25(indexed(spark, sf, documents), q, lexical.RRF_DEPTH), lexical.bm25(indexed(spark, sf, heads), q, lexical.RRF_DEPTH)])


def head_overlaps(spark: SparkSession, sf: str, candidates: DataFrame) -> DataFrame:
    """Jaccard of the tokens of query and head, for candidates alone."""
    sets = heads(spark, sf).select("id", F.array_distinct(T.tokens(F.col("text"))).alias("own"))
    asked = queries_of(spark, sf).select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    return candidates.select("query_id", "id").join(asked, "query_id").join(sets, "id").select("query_id", "id", T.jaccard(F.col("asked"), F.col("own")).alias("score"))


OVERLAP = f"""o AS (SELECT c.query_id, c.id, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS score FROM c
  JOIN (SELECT query_id, list_distinct({sql.tokens('text')}) AS x FROM ({sql.QUERIES})) USING (query_id) JOIN (SELECT id, list_distinct({sql.tokens('text')}) AS y FROM ({sql.HEADS})) USING (id))"""


@query(
    "linear_rerank",
    f"""WITH {sql.bm25(limit=50, name='c')}, {OVERLAP},
 m AS (SELECT query_id, id, rank AS before, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM c)
 {sql.top("SELECT query_id, id, before, round(m.s + coalesce(o.score, 0), 6) AS score FROM m LEFT JOIN o USING (query_id, id)", 10, 'before')}""",
)
def linear_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = saved(lexical.bm25(indexed(spark, sf, documents), queries_of(spark, sf), lexical.RERANK_DEPTH))
    return lexical.reranked(found, [(1.0, lexical.max_normalised(found)), (1.0, head_overlaps(spark, sf, found))])


@query(
    "hybrid_rerank",
    f"""WITH {sql.bm25(limit=50, name='c')}, {sql.bm25(sql.HEADS, limit=1000000, name='h')}, {OVERLAP},
 r AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM labels GROUP BY doc_id),
 m AS (SELECT query_id, id, rank AS before, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM c),
 hm AS (SELECT c.query_id, c.id, h.score / max(h.score) OVER (PARTITION BY c.query_id) AS s FROM c JOIN h USING (query_id, id))
 {sql.top("SELECT m.query_id, m.id, before, round(m.s + 0.4::DOUBLE * coalesce(hm.s, 0) + 0.075::DOUBLE * coalesce(r.score, 0) + 0.05::DOUBLE * coalesce(o.score, 0), 6) AS score FROM m LEFT JOIN hm USING (query_id, id) LEFT JOIN r USING (id) LEFT JOIN o USING (query_id, id)", 10, 'before')}""",
)
def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    q = queries_of(spark, sf)
    found = saved(lexical.bm25(indexed(spark, sf, documents), q, lexical.RERANK_DEPTH))
    head = lexical.max_normalised(lexical.scores(indexed(spark, sf, heads), q, found))
    api = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("score"))
    role = found.select("query_id", "id").join(api, "id")
    return lexical.reranked(found, [(1.0, lexical.max_normalised(found)), (0.4, head), (0.075, role), (0.05, head_overlaps(spark, sf, found))])


def dense_sql(where: str = "true", v: str = "n.v", q: str = "q.v", limit: int = 10) -> str:
    return f"WITH {sql.UNIT} " + sql.top(f"SELECT q.id AS query_id, n.id AS id, round(list_dot_product({v}, {q}), 6) AS score FROM n, n q WHERE q.id % 100 = 0 AND {where}", limit)


@query("dense_topk", dense_sql())
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(vectors(spark, sf), vector_queries(spark, sf))


@query("dense_filtered_topk", dense_sql("n.label = 3"))
def dense_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(vectors(spark, sf), vector_queries(spark, sf), where=F.col("label") == 3)


@query("dense_scores_for_ids", f"WITH {sql.UNIT} SELECT q.id AS query_id, n.id AS id, round(list_dot_product(n.v, q.v), 6) AS score FROM n, n q WHERE q.id % 100 = 0 AND n.label = 3")
def dense_scores_for_ids(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return dense.scores_for(v, vector_queries(spark, sf), v.where(F.col("label") == 3).select("id"))


CUT = "list_transform({0}[1:32], lambda x: x / sqrt(list_dot_product({0}[1:32], {0}[1:32])))"


@query("dense_projected_topk", dense_sql(v=CUT.format("n.v"), q=CUT.format("q.v")))
def dense_projected_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("id", V.projected(F.col("v"), 32).alias("v"))
    q = vector_queries(spark, sf).select("query_id", V.projected(F.col("q"), 32).alias("q"))
    return dense.search(v, q)


SMALL = "list_transform({0}, lambda x: CAST(floor(x * 127 + 0.5) AS INTEGER))"


@query(
    "int8_topk",
    f"WITH {sql.UNIT}, i AS (SELECT id, {SMALL.format('v')} AS w FROM n) " + sql.top("SELECT q.id AS query_id, i.id AS id, CAST(list_sum(list_transform(list_zip(i.w, q.w), lambda p: p[1] * p[2])) AS INTEGER) AS score FROM i, i q WHERE q.id % 100 = 0"),
)
def int8_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.int8_search(vectors(spark, sf), vector_queries(spark, sf))


@query(
    "binary_rescored_topk",
    f"WITH {sql.UNIT}, c AS (SELECT q.id AS query_id, n.id AS id, n.v AS v, q.v AS w, list_sum(list_transform(list_zip(n.v, q.v), lambda p: CASE WHEN (p[1] > 0) = (p[2] > 0) THEN 1 ELSE 0 END)) AS score FROM n, n q WHERE q.id % 100 = 0),"
    " f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM c) WHERE k <= 20) "
    + sql.top("SELECT query_id, id, round(list_dot_product(v, w), 6) AS score FROM f"),
)
def binary_rescored_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.binary_search(vectors(spark, sf), vector_queries(spark, sf))


BEST = f"WITH {sql.UNIT}, t AS ({sql.top('SELECT q.id AS query_id, n.id AS id, n.label AS label, round(list_dot_product(n.v, q.v), 6) AS score FROM n, n q WHERE q.id % 100 = 0', 50)})"


@query(
    "best_by_module",
    BEST + " SELECT query_id, label, max(score) AS best, count(*) AS module_count FROM t JOIN n USING (id) GROUP BY query_id, label",
)
def best_by_module(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    found = dense.search(v, vector_queries(spark, sf), 50).join(v.select("id", "label"), "id")
    return found.groupBy("query_id", "label").agg(F.max("score").alias("best"), F.count("*").alias("module_count"))


@query(
    "candidate_features",
    BEST
    + """, f AS (SELECT query_id, id, score AS code, label AS module, label % 4 AS package, id % 7 AS users FROM t JOIN n USING (id))
 SELECT query_id, id, code, round((code - avg(code) OVER q) / (stddev_pop(code) OVER q + 1e-6::DOUBLE), 4) AS code_z, CASE WHEN users = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unused, round(ln(1 + users), 6) AS log_users,
 round(max(code) OVER (PARTITION BY query_id, module) - code, 6) AS module_gap, round(max(code) OVER (PARTITION BY query_id, package) - code, 6) AS package_gap, count(*) OVER (PARTITION BY query_id, module) AS module_count,
 round(code - max(code) OVER q, 6) AS code_gap FROM f WINDOW q AS (PARTITION BY query_id)""",
)
def candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    found = dense.search(v, vector_queries(spark, sf), 50).join(v.select("id", "label"), "id")
    rows = found.select("query_id", "id", F.col("score").alias("code"), F.col("label").alias("module"), (F.col("label") % 4).alias("package"), (F.col("id") % 7).alias("users"))
    return features.candidate_features(rows)
