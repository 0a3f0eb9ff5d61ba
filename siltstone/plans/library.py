"""Catalogue queries: use counts, filters, versions, states, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import releases, usage
from siltstone.plans.registry import query
from siltstone.sources.tables import table

EDGES = "SELECT DISTINCT o_custkey AS user, l_partkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
EXTERNAL = "SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY l_partkey"
COUNTS = f"SELECT key, CAST(sum(users) AS BIGINT) AS users FROM (SELECT key, count(*) AS users FROM ({EDGES}) GROUP BY key UNION ALL {EXTERNAL}) GROUP BY key"


def edges(spark: SparkSession, sf: str, before: str | None = None, after: str | None = None) -> DataFrame:
    orders = table(spark, sf, "orders")
    if before:
        orders = orders.where(F.col("o_orderdate") < before)
    if after:
        orders = orders.where(F.col("o_orderdate") >= after)
    return orders.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("key"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    external = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.countDistinct("l_suppkey").alias("users"))
    return usage.user_counts(edges(spark, sf), external)


@query("user_counts", COUNTS)
def user_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf)


SPLIT_DATE = "1995-06-17"


@query("user_count_deltas", "SELECT key, count(*) AS users FROM (SELECT l_partkey AS key, o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY key")
def user_count_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The counts before a date plus the changes since equal a recount."""
    old = edges(spark, sf, before=SPLIT_DATE).groupBy("key").agg(F.count("*").alias("users"))
    changes = edges(spark, sf, after=SPLIT_DATE).groupBy("key").agg(F.count("*").alias("delta"))
    return usage.applied(old, changes)


@query(
    "most_used_filtered",
    f"""SELECT key, users FROM ({COUNTS}) WHERE key IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') AND key IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
 ORDER BY users DESC, key LIMIT 50""",
)
def most_used_filtered(spark: SparkSession, sf: str) -> DataFrame:
    brand = table(spark, sf, "part").where(F.col("p_brand") == "Brand#11").select(F.col("p_partkey").alias("key"))
    by = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("key"))
    return usage.most_used(counts(spark, sf), 50, brand, by)


@query("used_by_union", "SELECT l_partkey AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 3")
def used_by_union(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    own = edges(spark, sf).where(F.col("user") == 7).select("key")
    return own.union(item.where(F.col("l_suppkey") == 3).select("l_partkey")).distinct()


@query(
    "filter_intersection",
    "SELECT l_partkey AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 1 INTERSECT SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 2",
)
def filter_intersection(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).join(table(spark, sf, "customer"), F.col("user") == F.col("c_custkey"))
    return e.where(F.col("c_nationkey") == 1).select("key").intersect(e.where(F.col("c_nationkey") == 2).select("key"))


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return releases.latest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query(
    "version_order",
    """SELECT p_brand AS name, version, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_partkey) AS INTEGER) AS place FROM
 (SELECT p_brand, p_partkey, p_size || '.' || (p_partkey % 12) || '.0' AS version, list_transform(string_split(p_size || '.' || (p_partkey % 12) || '.0', '.'), lambda x: CAST(x AS BIGINT)) AS v FROM part)""",
)
def version_order(spark: SparkSession, sf: str) -> DataFrame:
    version = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 12, F.lit(".0"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("name"), version.alias("version"), "p_partkey")
    place = F.row_number().over(Window.partitionBy("name").orderBy(T.version_order(F.col("version")).desc(), "p_partkey"))
    return rows.select("name", "version", place.alias("place"))


@query("next_older_release", "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS older FROM orders")
def next_older_release(spark: SparkSession, sf: str) -> DataFrame:
    return releases.next_older(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "older")


@query(
    "release_state_left_join",
    """SELECT c_custkey, count(o_orderkey) AS orders, CASE WHEN coalesce(bool_or(o_orderstatus = 'F'), false) THEN 'invalid' WHEN count(o_orderkey) > 0 THEN 'indexed' ELSE 'unindexed' END AS state
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def release_state_left_join(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.bool_or(F.col("o_orderstatus") == "F").alias("bad"))
    rows = table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), releases.state(F.coalesce("bad", F.lit(False)), F.col("orders").isNotNull()).alias("state"))


@query("anti_unindexed", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("semi_exists", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(returned, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query(
    "uses_condition",
    """SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_custkey = 11)
 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 5)""",
)
def uses_condition(spark: SparkSession, sf: str) -> DataFrame:
    internal = edges(spark, sf).where(F.col("user") == 11).select("key")
    external = table(spark, sf, "lineitem").where(F.col("l_suppkey") == 5).select(F.col("l_partkey").alias("key"))
    return table(spark, sf, "part").join(internal.union(external), F.col("p_partkey") == F.col("key"), "left_semi").select("p_partkey")


@query(
    "lateral_sizes",
    """SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS segments,
 (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""",
)
def lateral_sizes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return rows.fillna(0, ["customers", "segments", "suppliers"])


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("job_status_counts", f"SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE event_type = '{k}') AS {k}''' for k in KINDS)} FROM events GROUP BY user_id")
def job_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return releases.status_counts(table(spark, sf, "events"), "user_id", "event_type", KINDS)


@query(
    "ordered_array_agg",
    "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey",
)
def ordered_array_agg(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("all"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.array_join(F.transform("all", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"), "n")


@query(
    "used_keys",
    "SELECT o_custkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS keys FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_custkey",
)
def used_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = edges(spark, sf).groupBy(F.col("user").alias("o_custkey")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return rows.select("o_custkey", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query(
    "problem_groups",
    """SELECT event_type, k, count(*) AS n, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS users, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type, k) AS INTEGER) AS place
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type, k""",
)
def problem_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    found = rows.groupBy("event_type", "k", F.col("user_id").cast("string").alias("user")).agg(F.count("*").alias("n"))
    found = found.groupBy("event_type", "k").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("user")), ",").alias("users"))
    # a row per (type, k), one of few settings: the ranking reads the groups, not the events
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type", "k")))


@query("count_over_total", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def count_over_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_totalprice")
    return releases.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 25)


@query("paging_offset", "SELECT event_id, user_id FROM events ORDER BY user_id, ts DESC, event_id LIMIT 40 OFFSET 120")
def paging_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy("user_id", F.desc("ts"), "event_id").offset(120).limit(40).select("event_id", "user_id")


@query("text_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"))


@query("known_hashes", "SELECT digest, count(*) AS n FROM (SELECT sha256(text) AS digest FROM documents UNION ALL SELECT sha256(text) FROM conversations) GROUP BY digest")
def known_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(T.digest(F.col("text")).alias("digest")).unionByName(table(spark, sf, "conversations").select(T.digest(F.col("text")).alias("digest")))
    return rows.groupBy("digest").agg(F.count("*").alias("n"))


@query("json_errors", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def json_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where(F.col("event_type") == "error").withColumn("props", F.from_json("props", "map<string,bigint>"))
    return rows.select("event_id", "event_type", F.explode("props").alias("name", "k")).where(F.col("name") == "k").groupBy("event_type", "k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "superseded_releases",
    """SELECT user_id, count(*) FILTER (WHERE seen) AS superseded, max(ts_order) AS live FROM (SELECT user_id, epoch_us(ts) AS ts_order,
 coalesce(epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM events) GROUP BY user_id""",
)
def superseded_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals by event_id: one older than what is live already is superseded; the latest stays live."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    before = F.max("at").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("late", F.coalesce(F.col("at") < before, F.lit(False))).groupBy("user_id").agg(F.count_if("late").alias("superseded"), F.max("at").alias("live"))


@query(
    "queue_claim_order",
    "SELECT event_id, CAST(row_number() OVER (ORDER BY event_type <> 'signup', ts, event_id) AS INTEGER) AS place FROM events WHERE event_type IN ('signup', 'error') ORDER BY place LIMIT 100",
)
def queue_claim_order(spark: SparkSession, sf: str) -> DataFrame:
    """The next hundred jobs: base first, then by age; the limit is taken before places are given."""
    jobs = table(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    order = [F.col("event_type") != "signup", F.col("ts"), F.col("event_id")]
    first = jobs.orderBy(*order).limit(100)
    return first.select("event_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("retry_backoff", "SELECT user_id, event_id, CAST(attempt AS INTEGER) AS attempt, CAST(least(pow(2, attempt - 1) * 60, 3600) AS BIGINT) AS wait, attempt >= 5 AS final FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')")
def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").where(F.col("event_type") == "error").withColumn("attempt", attempt)
    return rows.select("user_id", "event_id", "attempt", F.least(F.pow(F.lit(2.0), F.col("attempt") - 1) * 60, F.lit(3600.0)).cast("long").alias("wait"), (F.col("attempt") >= 5).alias("final"))


@query(
    "owner_override",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag = 'R' THEN l_suppkey END, own.owner) AS owner FROM lineitem LEFT JOIN (SELECT l_partkey AS p, min(l_suppkey) AS owner FROM lineitem GROUP BY l_partkey) own ON p = l_partkey",
)
def owner_override(spark: SparkSession, sf: str) -> DataFrame:
    """Each use's owner: the version it names itself, else the default one of its key."""
    item = table(spark, sf, "lineitem")
    default = item.groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("default"))
    rows = item.join(default, F.col("p") == F.col("l_partkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")), F.col("default")).alias("owner"))


@query(
    "budgeted_selection",
    """WITH RECURSIVE o AS (SELECT p_brand, p_name, p_partkey, p_size AS size, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS k, p_retailprice AS price FROM part),
 r AS (SELECT p_brand, p_name, p_partkey, size, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, p_partkey) AS n FROM o WHERE k = 1),
 f AS (SELECT p_brand, p_name, p_partkey, size, n, size <= 500 AS taken, CASE WHEN size <= 500 THEN size ELSE 0 END AS total FROM r WHERE n = 1 UNION ALL
  SELECT r.p_brand, r.p_name, r.p_partkey, r.size, r.n, f.total + r.size <= 500, CASE WHEN f.total + r.size <= 500 THEN f.total + r.size ELSE f.total END FROM f JOIN r ON r.p_brand = f.p_brand AND r.n = f.n + 1)
 SELECT p_brand, p_name, p_partkey, size FROM f WHERE taken""",
)
def budgeted_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest first, one part of each name, up to a size of 500 a brand; one that is too large for the rest is passed over."""
    part = table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", F.col("p_size").alias("size"), "p_retailprice")
    one = releases.latest(part, ["p_brand", "p_name"], F.desc("p_retailprice"), F.col("p_partkey"))
    return releases.within_budget(one, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], "size", 500).select("p_brand", "p_name", "p_partkey", "size")
