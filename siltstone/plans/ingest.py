"""Queries on sources, changes to tables, spans and wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators import blocks, spans, tables
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.plans.search import documents
from siltstone.sources import files
from siltstone.sources.tables import table


@query(
    "manifest_entries",
    r"""SELECT doc_id AS id, sha256(text) AS digest, source || '/' || lang || ' ' || doc_id || '.txt' AS path, false AS valid FROM documents WHERE lang = 'fr'
 UNION ALL SELECT doc_id, sha256(text), source || '/' || doc_id || '.txt', true FROM documents WHERE lang <> 'fr'""",
)
def manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("lang") == "fr", F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    text = F.concat(F.sha2("text", 256), F.lit(" "), "source", F.lit("/"), name, F.lit(".txt\n"))
    return files.manifest_entries(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))


@query("files_by_glob", r"SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^(en|fr)/[^/]*\.html$') AND NOT regexp_matches(path, '(^|/)1[^/]*$')")
def files_by_glob(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path"))
    return rows.where(files.fits(F.col("path"), "/en/*.html", "/fr/*.html", "!1*"))


@query("box_parameters", r"SELECT key, value, count(*) AS n FROM (SELECT string_split(p, '=')[1] AS key, string_split(p, '=')[2] AS value FROM (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages) WHERE contains(p, '=')) GROUP BY key, value")
def box_parameters(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "pages").select(F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("p")).where(F.col("p").contains("="))
    return pairs.select(F.substring_index("p", "=", 1).alias("key"), F.regexp_extract("p", "^[^=]*=([^=]*)", 1).alias("value")).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("insert_if_absent", "WITH o AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F') SELECT key, 'old' AS origin FROM o UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT key FROM o)")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    old = orders.where(F.col("o_orderstatus") == "F").select("key").distinct().withColumn("origin", F.lit("old"))
    return tables.inserted(old, orders.select("key", F.lit("new").alias("origin")), "key")


@query("latest_wins_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def latest_wins_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return tables.upserted(table(spark, sf, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("sync_plan", "SELECT l_partkey, arg_min(l_orderkey, l_orderkey) AS l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "part").where(F.col("p_size") > 10).select(F.col("p_partkey").alias("l_partkey"))
    return files.unknown(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey"), known, "l_partkey", "l_orderkey")


@query(
    "promote_newest",
    """SELECT p_brand, p_partkey, CASE WHEN p_partkey = n THEN 'live' WHEN p_partkey < n THEN 'retired' ELSE 'building' END AS state
 FROM (SELECT *, max(CASE WHEN p_size <= 25 THEN p_partkey END) OVER (PARTITION BY p_brand) AS n FROM part)""",
)
def promote_newest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.promoted(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", F.col("p_size") <= 25).select("p_brand", "p_partkey", "state")


@query("retired_cleanup", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retired_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    newest = rows.agg(F.max("ts").alias("newest"))  # one row
    return rows.where(F.col("event_type") == "view").crossJoin(F.broadcast(newest)).where(F.col("ts") < F.col("newest") - F.expr("INTERVAL 10 DAYS")).select("event_id", "user_id")


@query("restore_counts", "SELECT coalesce(a.key, b.key) AS key, coalesce(here, 0) AS here, coalesce(there, 0) AS there FROM (SELECT o_custkey AS key, count(*) AS here FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS key, count(*) AS there FROM events GROUP BY 1) b ON a.key = b.key WHERE coalesce(here, 0) <> coalesce(there, 0)")
def restore_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.differing(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf, "events").select(F.col("user_id").alias("key")), "key")


@query("newer_release", "SELECT o_orderkey, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate > a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey > a.o_orderkey))) AS superseded FROM orders a")
def newer_release(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a later release of the same name is there: one aggregate per name instead of a join by inequality."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey")).over(Window.partitionBy("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", (F.struct("o_orderdate", "o_orderkey") < latest).alias("superseded"))


@query("line_of_offset", "SELECT doc_id, length(text[1:n_chars // 2]) - length(replace(text[1:n_chars // 2], chr(10), '')) + 1 AS line FROM documents")
def line_of_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", spans.line_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("line"))


@query(
    "spans_per_line",
    """WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, length(x[i]) AS n, n_chars // 4 AS s, n_chars // 2 AS e FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS x FROM documents) d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
 f AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM l)
 SELECT doc_id AS id, line, CAST(greatest(s - first, 0) AS BIGINT) AS start, CAST(least(e - first, n) AS BIGINT) AS "end" FROM f WHERE greatest(s - first, 0) < least(e - first, n)""",
)
def spans_per_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.floor(F.col("n_chars") / 4).alias("start"), F.floor(F.col("n_chars") / 2).alias("end"))
    return spans.by_line(rows)


@query("url_encoding", "SELECT p_partkey, url_encode(p_name || ' @' || p_brand) AS encoded FROM part")
def url_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.replace(F.url_encode(F.concat("p_name", F.lit(" @"), "p_brand")), F.lit("+"), F.lit("%20")).alias("encoded"))


@query("hashed_word_vectors", f"WITH t AS (SELECT item_id, unnest({sql.tokens('text')}) AS term FROM benchmark), c AS (SELECT item_id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 8 AS place, count(*) AS n FROM t GROUP BY ALL) SELECT item_id, CAST(place AS INTEGER) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c")
def hashed_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as a vector of eight places: words hashed to places and counted, brought to length 1."""
    rows = table(spark, sf, "benchmark").select("item_id", F.transform(T.tokens(F.col("text")), lambda t: T.fold(t, 8)).alias("places"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter("places", lambda p: p == i)).cast("double"))
    return rows.select("item_id", F.posexplode(V.normalised(counts)).alias("place", "w")).where("w > 0").select("item_id", "place", F.round("w", 6).alias("weight"))


@query("load_errors", "SELECT name, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, regexp_extract('cannot find Kit.part' || CAST(json_extract(props, '$.k') AS VARCHAR) || '@1.0 here', 'find ([A-Za-z.0-9]+)@', 1) AS name FROM events WHERE event_type = 'error') GROUP BY name")
def load_errors(spark: SparkSession, sf: str) -> DataFrame:
    message = F.concat(F.lit("cannot find Kit.part"), F.get_json_object("props", "$.k"), F.lit("@1.0 here"))
    rows = table(spark, sf, "events").where(F.col("event_type") == "error").select("event_id", F.regexp_extract(message, "find ([A-Za-z.0-9]+)@", 1).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("shortened_heads", r"SELECT doc_id, CASE WHEN len(x) > 3 THEN array_to_string(x[1:3], chr(10)) || chr(10) || '…' ELSE array_to_string(x, chr(10)) END AS head FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM documents)")
def shortened_heads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.shortened(F.col("text"), 3).alias("head"))


@query("json_answers", "SELECT event_id, json_keys(props) = ['k'] AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 49 AS valid FROM events")
def json_answers(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", ((F.json_object_keys("props") == F.array(F.lit("k"))) & parsed["k"].between(0, 49)).alias("valid"))


@query("complete_windows", "SELECT conv_id, turn // 4 AS part, count(*) AS turns, count(DISTINCT role) AS roles, count(*) FILTER (WHERE length(text) = 0) = 0 AND count(*) = 4 AS complete FROM conversations GROUP BY conv_id, turn // 4")
def complete_windows(spark: SparkSession, sf: str) -> DataFrame:
    part = F.floor(F.col("turn") / 4).alias("part")
    rows = table(spark, sf, "conversations").groupBy("conv_id", part)
    return rows.agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), ((F.count_if(F.length("text") == 0) == 0) & (F.count("*") == 4)).alias("complete"))


@query("file_lines_page", "SELECT doc_id AS id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) > 5 AS more FROM documents WHERE text <> ''")
def file_lines_page(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page of five lines leaves more of a text."""
    return blocks.numbered_lines(documents(spark, sf)).groupBy("id").agg((F.count("*") > 5).alias("more"))
