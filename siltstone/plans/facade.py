"""Queries through the library facade and its wording: search by words, by filters and by both, a definition's detail, import lines, counts in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.library import Filters, Library
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.plans.search import STOPWORDS
from siltstone.sources.tables import table

EDGES = "SELECT p_partkey::VARCHAR AS a, (p_partkey // 3)::VARCHAR AS b FROM part WHERE p_partkey // 3 >= 1"


def library(spark: SparkSession, sf: str) -> Library:
    """Parts as definitions: the brand is the package, and a part uses the one of a third of its number."""
    part = table(spark, sf, "part")
    number = F.col("p_partkey").cast("string")
    edges = part.where("p_partkey >= 3").select(number.alias("a"), F.floor(F.col("p_partkey") / 3).cast("string").alias("b"))
    return Library(part.select(number.alias("id"), F.col("p_brand").alias("package"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_name").alias("text")), edges)


@query("library_words", f"""WITH {sql.bm25("SELECT p_partkey::VARCHAR AS id, p_name AS text FROM part WHERE p_brand = 'Brand#3'", "SELECT 0 AS query_id, 'red widgets, small ring' AS text")} SELECT rank, id, score FROM bm25""")
def library_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words and filters: filters narrow before the ranking."""
    return library(spark, sf).search("red widgets, small ring", Filters(packages=("Brand#3",)))


@query(
    "library_most_used",
    f"WITH e AS ({EDGES}) SELECT p_partkey::VARCHAR AS id, (SELECT count(*) FROM e WHERE b = p_partkey::VARCHAR) AS users FROM part WHERE p_brand = 'Brand#3' AND p_partkey IN (SELECT a::BIGINT FROM e) ORDER BY users DESC, id LIMIT 10",
)
def library_most_used(spark: SparkSession, sf: str) -> DataFrame:
    """Filters without words: the most used first."""
    lib = library(spark, sf)
    users = Library(lib.definitions.join(lib.edges.select(F.col("a").alias("id")), "id", "left_semi"), lib.edges)
    return users.search(filters=Filters(packages=("Brand#3",)))


@query("library_contradiction", "SELECT p_partkey::VARCHAR AS id, p_brand AS package FROM part WHERE false")
def library_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """Two packages at once: nothing can pass."""
    return library(spark, sf).narrowed(Filters(packages=("Brand#3", "Brand#4"))).select("id", "package")


@query("library_used_by", f"WITH e AS ({EDGES}) SELECT p_partkey::VARCHAR AS id, p_brand AS package FROM part WHERE p_partkey::VARCHAR IN (SELECT a FROM e WHERE b = '7')")
def library_used_by(spark: SparkSession, sf: str) -> DataFrame:
    return library(spark, sf).narrowed(Filters(uses=("7",))).select("id", "package")


@query("definition_detail", f"WITH e AS ({EDGES}) SELECT p_partkey::VARCHAR AS id, p_name AS text, (SELECT string_agg(a, ',' ORDER BY a) FROM e WHERE b = '7') AS users, (SELECT string_agg(b, ',' ORDER BY b) FROM e WHERE a = '7') AS uses FROM part WHERE p_partkey = 7")
def definition_detail(spark: SparkSession, sf: str) -> DataFrame:
    return library(spark, sf).definition("7").select("id", "text", F.array_join("users", ",").alias("users"), F.array_join("uses", ",").alias("uses"))


PASCAL = "array_to_string(list_transform(list_filter(string_split_regex({0}, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: upper(x[1:1]) || x[2:]), '')"
BASE = "CASE WHEN p_size % 2 = 0 THEN p_brand || '-' || replace(p_name, ' ', '_') ELSE p_size || p_name END"


@query(
    "import_lines",
    f"""SELECT k, path, CASE WHEN NOT regexp_matches(p, '^[A-Za-z]') THEN 'M' || p ELSE p END AS alias, 'import ' || path || ' as ' || CASE WHEN NOT regexp_matches(p, '^[A-Za-z]') THEN 'M' || p ELSE p END AS line, p_type AS last
 FROM (SELECT p_partkey AS k, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand || '-' || replace(p_name, ' ', '_') || '/main' ELSE p_brand || '-' || replace(p_name, ' ', '_') || '/src/' || p_size || p_name END AS path, {PASCAL.format(BASE)} AS p FROM part)""",
)
def import_lines(spark: SparkSession, sf: str) -> DataFrame:
    """How a definition is imported: its file's path, the alias of its module (of `main`, of its package) and the last part of its name."""
    package = F.concat("p_brand", F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("_")))
    module = F.when(F.col("p_size") % 2 == 0, "main").otherwise(F.concat(F.lit("src/"), F.col("p_size").cast("string"), "p_name"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("/", package, module).alias("path"), T.alias(package, module).alias("alias"), T.last_part(F.concat_ws(".", "p_brand", "p_type")).alias("last"))
    return rows.select("k", "path", "alias", F.concat(F.lit("import "), "path", F.lit(" as "), "alias").alias("line"), "last")


@query("counts_in_words", "SELECT o_custkey, format('{:,}', sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT) || ' credits' AS spent, count(*) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS orders FROM orders GROUP BY o_custkey HAVING sum(CAST(floor(o_totalprice) AS BIGINT)) > 1")
def counts_in_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("spent"), F.count("*").alias("orders"))
    return rows.where("spent > 1").select("o_custkey", T.counted(F.col("spent"), "credit").alias("spent"), T.counted(F.col("orders"), "order").alias("orders"))


STOP = "[" + ", ".join(map(repr, STOPWORDS)) + "]"


@query(
    "stem_shares",
    f"""SELECT item_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS share FROM (SELECT item_id, list_distinct(list_transform(list_filter({sql.tokens('text')}, lambda t: NOT list_contains({STOP}, t)), lambda t: {sql.singular('t')})) AS a,
 list_distinct(list_transform(list_filter({sql.tokens("string_split(text, '.')[1]")}, lambda t: NOT list_contains({STOP}, t)), lambda t: {sql.singular('t')})) AS b FROM benchmark)""",
)
def stem_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a passage's stems its first sentence holds."""
    stop = F.array(*map(F.lit, STOPWORDS))
    rows = table(spark, sf, "benchmark").select("item_id", T.content_stems(F.col("text"), stop).alias("a"), T.content_stems(F.get(F.split("text", "[.]"), F.lit(0)), stop).alias("b"))
    return rows.select("item_id", F.round(T.share(F.col("b"), F.col("a")), 6).alias("share"))


@query("comment_balance", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS open FROM part")
def comment_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Open parentheses of a line, but for those in its comment."""
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("f((x) # (("), "p_name")).otherwise(F.concat(F.lit("g(x) # )"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", T.balance(T.without_comment(line)).alias("open"))
