"""Queries on records: listings and benchmark lines with their problems, releases written and deleted, generations, judgments, small readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import graph, tables, usage
from siltstone.operators.definitions import label
from siltstone.plans.registry import query
from siltstone.sources.tables import table


@query(
    "listing_status",
    """SELECT event_id, CASE WHEN k % 7 = 0 THEN 'error' WHEN k % 5 = 0 THEN 'rejected: no name' WHEN k % 3 = 0 THEN 'rejected: no hash' ELSE 'listed' END AS status FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def listing_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing as JSON text: what can't be read is an error, what lacks a name or a hash is rejected with the reason, the rest is listed."""
    k = F.get_json_object("props", "$.k").cast("long")
    name, hash_ = F.when(k % 5 != 0, F.lit("kit")), F.when(k % 3 != 0, F.sha2(k.cast("string"), 256))
    text = F.when(k % 7 == 0, F.lit('{"name": "kit", "hash"')).otherwise(F.to_json(F.struct(name.alias("name"), hash_.alias("hash"))))
    rows = table(spark, sf, "events").select("event_id", F.from_json(text, "name string, hash string, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("x"))
    status = F.when(F.col("x.bad").isNotNull(), "error").when(F.col("x.name").isNull(), "rejected: no name").when(~F.coalesce(F.col("x.hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "rejected: no hash")
    return rows.select("event_id", F.coalesce(status, F.lit("listed")).alias("status"))


@query(
    "line_problems",
    """WITH r AS (SELECT doc_id % 10 AS file, CAST(row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS INTEGER) AS line, quality, toxic FROM labels)
 SELECT file, line, CASE WHEN quality = 0 AND toxic = 1 THEN 'not JSON' WHEN quality = 0 THEN 'no query' WHEN toxic = 1 THEN 'grade beyond 3' END AS problem FROM r WHERE quality = 0 OR toxic = 1""",
)
def line_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark file in lines of JSON: one bad line fails nothing, and every problem names its line."""
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    good = F.to_json(F.struct(F.when(~bad, F.lit("sort a list")).alias("query"), F.when(toxic, 4).otherwise(2).alias("grade")))
    text = F.when(bad & toxic, F.lit('{"query": ')).otherwise(good)
    content = table(spark, sf, "labels").groupBy((F.col("doc_id") % 10).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("text")))).alias("x"))
    files = content.select("file", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "content")).select("file", (F.col("at") + 1).alias("line"), F.from_json("content", "query string, grade int, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("x"))
    problem = F.when(F.col("x.bad").isNotNull(), "not JSON").when(F.col("x.query").isNull(), "no query").when(~F.col("x.grade").between(1, 3), "grade beyond 3")
    return lines.select("file", "line", problem.alias("problem")).where(F.col("problem").isNotNull())


@query("release_pointers", "SELECT event_id, CASE WHEN s_suppkey % 4 = 0 THEN 'h' || s_suppkey ELSE s_name || '@' || s_nationkey || '.0' END AS label FROM events LEFT JOIN supplier ON s_suppkey = user_id WHERE s_suppkey IS NOT NULL")
def release_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Names resolved to releases by a pointer table; a release without a name is called by its hash."""
    named = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name"))
    pointers = table(spark, sf, "supplier").select("s_suppkey", label(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")), named, F.concat(F.col("s_nationkey").cast("string"), F.lit(".0"))).alias("label"))
    return table(spark, sf, "events").join(pointers, F.col("user_id") == F.col("s_suppkey")).select("event_id", "label")


USES = "SELECT o_custkey AS release, l_partkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(
    "release_replaced",
    f"""WITH u AS ({USES}), a AS (SELECT key, count(*) AS users FROM u GROUP BY key), gone AS (SELECT key, -count(*) AS users FROM u WHERE release % 10 = 3 GROUP BY key), new AS (SELECT key + 1 AS key, count(*) AS users FROM u WHERE release % 10 = 3 AND key % 2 = 0 GROUP BY key + 1)
 SELECT key, CAST(sum(users) AS BIGINT) AS users FROM (SELECT * FROM a UNION ALL SELECT * FROM gone UNION ALL SELECT * FROM new) GROUP BY key""",
)
def release_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Some releases' rows are deleted and others written instead: the counts follow by signed changes, and keys stay although nothing uses them any more."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("release"), F.col("l_partkey").alias("key"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("users"))
    old = rows.where("release % 10 = 3")
    deleted = old.groupBy("key").agg((-F.count("*")).alias("delta"))
    written = old.where("key % 2 = 0").groupBy((F.col("key") + 1).alias("key")).agg(F.count("*").alias("delta"))
    return usage.applied(per_key, deleted.unionByName(written), always=per_key.select("key").unionByName(written.select("key")))


@query("vectors_replaced", "SELECT vec_id, label, CASE WHEN label = 4 THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE label <> 7")
def vectors_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors upserted by id and deleted by what their payload says."""
    stored = table(spark, sf, "embeddings").select("vec_id", "label", F.lit("old").alias("state"))
    written = stored.where("label = 4").withColumn("state", F.lit("new"))
    both = stored.withColumn("at", F.lit(0)).unionByName(written.withColumn("at", F.lit(1)))
    return tables.upserted(both, ["vec_id"], "at").select("vec_id", "label", "state").where("label <> 7")


@query("generation_scan", "SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'F'")
def generation_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the generations of one corpus in one state; no corpus means all of them."""
    return _generation(spark, sf, 3, "F")


@query("generation_all", "SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def generation_all(spark: SparkSession, sf: str) -> DataFrame:
    return _generation(spark, sf, None, "P")


def _generation(spark: SparkSession, sf: str, corpus: int | None, state: str) -> DataFrame:
    some = table(spark, sf, "customer")
    some = some if corpus is None else some.where(F.col("c_nationkey") == corpus)
    return some.join(table(spark, sf, "orders").where(F.col("o_orderstatus") == state), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderpriority")


@query("queries_within", "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))")
def queries_within(spark: SparkSession, sf: str) -> DataFrame:
    """Orders (queries) all of whose parts (answers) are inside the corpus: those with a part outside go by an anti-join."""
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    inside = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    outside = answers.join(inside, "l_partkey", "left_anti").select("o_orderkey")
    return answers.select("o_orderkey").distinct().join(outside, "o_orderkey", "left_anti")


def judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Judgments with the hash of what was asked then, and the hash of what would be asked now: the texts of some have changed."""
    asked = F.sha2(F.concat_ws("|", "conv_id", "turn", "text"), 256)
    rows = table(spark, sf, "conversations")
    now = rows.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.sha2(F.concat_ws("|", "conv_id", "turn", F.concat("text", F.lit("!"))), 256)).otherwise(asked).alias("request"))
    return rows.select("conv_id", "turn", asked.alias("request")), now


@query("stale_judgments", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 1")
def stale_judgments(spark: SparkSession, sf: str) -> DataFrame:
    then, now = judged(spark, sf)
    return then.join(now.withColumnRenamed("request", "now"), ["conv_id", "turn"]).where("request <> now").select("conv_id", "turn")


@query("current_judgments", "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1")
def current_judgments(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf)[0].join(stale_judgments(spark, sf), ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("limited_neighbours", """SELECT o_custkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_partkey) FILTER (WHERE n <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS parts
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) GROUP BY o_custkey""")
def limited_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The first five neighbours of each, and how many more there are. Only five rows a node are gathered, however many it has."""
    e = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_partkey"))).where("n <= 5")
    shown = first.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ", ").alias("shown"))
    total = e.groupBy("o_custkey").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > 5, F.format_string(" and %d more", F.col("n") - 5)).otherwise("")
    return shown.join(total, "o_custkey").select("o_custkey", F.concat("shown", more).alias("parts"))


@query("preview", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 3), b AS (SELECT p_partkey AS k FROM part WHERE p_size < 25) SELECT k, least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS total FROM a JOIN b USING (k) ORDER BY k LIMIT 5""")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """Five of what passes all filters; at most as many as the smallest filter holds."""
    a = table(spark, sf, "lineitem").where("l_suppkey = 3").select(F.col("l_partkey").alias("k")).distinct()
    b = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    sizes = a.agg(F.count("*").alias("x")).crossJoin(b.agg(F.count("*").alias("y"))).select(F.least("x", "y").alias("total"))  # one row each
    return a.join(b, "k").orderBy("k").limit(5).crossJoin(F.broadcast(sizes))


@query("problem_messages", """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'expected k' || k ELSE 'expected k' || k || ', observed ' || event_type END AS message FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def problem_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What was expected, and what was seen where that says more."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("expected k"), k).alias("expected"), F.when(k.cast("long") % 2 == 0, F.concat(F.lit("'k"), k, F.lit("'"))).otherwise(F.col("event_type")).alias("observed"))
    known = F.col("expected").contains(F.trim("observed", F.lit("'")))
    return rows.select("event_id", F.when(known, F.col("expected")).otherwise(F.concat("expected", F.lit(", observed "), "observed")).alias("message"))


@query("marked_lines", "SELECT p_partkey, CAST(least(p_size, p_partkey % 60) AS BIGINT) AS first, CAST(greatest(p_size, p_partkey % 60) AS BIGINT) AS last, CAST(abs(p_size - p_partkey % 60) + 1 AS BIGINT) AS lines FROM part")
def marked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """`first-last` read in either order."""
    text = table(spark, sf, "part").select("p_partkey", F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string")).alias("t"))
    a, b = (F.regexp_extract("t", r"^(\d+)-(\d+)$", i).cast("long") for i in (1, 2))
    rows = text.select("p_partkey", F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))
    return rows.select("p_partkey", "first", "last", (F.col("last") - F.col("first") + 1).alias("lines"))


@query("name_fixpoint", "WITH RECURSIVE f AS (SELECT p_partkey AS name FROM part WHERE p_size = 50 UNION SELECT f.name // 3 FROM f WHERE f.name // 3 >= 1) SELECT name FROM f")
def name_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The names of some parts and of all that they import, and those import, until no new name comes."""
    part = table(spark, sf, "part")
    edges = part.select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).alias("b")).where("b >= 1")
    start = part.where("p_size = 50").select(F.col("p_partkey").alias("start"))
    return start.select(F.col("start").alias("name")).union(graph.reached(edges, start).select("node")).distinct()


@query("enqueued_once", "SELECT o_custkey AS job, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'queued before' ELSE 'new' END) AS state FROM orders GROUP BY o_custkey")
def enqueued_once(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs are enqueued once: those queued before stay as they are, of repeated new ones one comes in."""
    orders = table(spark, sf, "orders")
    queue = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("job"), F.lit("queued before").alias("state")).distinct()
    return tables.inserted(queue, orders.select(F.col("o_custkey").alias("job"), F.lit("new").alias("state")), "job")


@query("dev_corpus", """SELECT b AS name, CAST(r AS INTEGER) AS place, n AS parts FROM (SELECT p_brand AS b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand) WHERE r <= 10""")
def dev_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The list of a small corpus, written as one JSON text and read back: the first ten packages. One that is missing from the store is an error."""
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    ten = sizes.orderBy(F.desc("n"), "p_brand").limit(10)
    text = ten.agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_brand")))).alias("t"))
    listed = text.select(F.posexplode(F.from_json("t", "array<struct<n:long,p_brand:string>>")).alias("at", "x")).select(F.col("x.p_brand").alias("name"), (F.col("at") + 1).alias("place"))
    found = listed.join(sizes, F.col("name") == F.col("p_brand"), "left")
    return found.select("name", "place", F.coalesce("n", F.raise_error(F.concat(F.lit("not in the store: "), "name")).cast("long")).alias("parts"))


@query("source_file", "SELECT page_id, 'kit@' || (page_id % 5) || '.0' AS release, length(html) AS n, len(regexp_extract_all(html, 'href=\"/([^\"]*)\"')) AS links FROM pages WHERE page_id % 7 = 2 AND page_id % 5 <> 4")
def source_file(spark: SparkSession, sf: str) -> DataFrame:
    """Files of stored releases by release and path, with what they link to; a release that isn't stored gives nothing."""
    asked = table(spark, sf, "pages").where("page_id % 7 = 2").select("page_id", (F.col("page_id") % 5).alias("hash"), "html")
    stored = spark.range(4).select(F.col("id").alias("hash"), label(F.col("id").cast("string"), F.lit("kit"), F.concat(F.col("id").cast("string"), F.lit(".0"))).alias("release"))
    links = F.size(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).cast("long")
    return asked.join(stored, "hash").select("page_id", "release", F.length("html").cast("long").alias("n"), links.alias("links"))
