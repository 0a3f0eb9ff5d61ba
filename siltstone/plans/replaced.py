"""Queries on releases that are written to disk and replaced. A customer is a package, its orders of a status are a release, of version 1 or 2."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph, store
from siltstone.plans.registry import query
from siltstone.sources.tables import table

ROWS = "key long, users long"


def releases(spark: SparkSession, sf: str) -> DataFrame:
    """package, release, version, key, users: the parts that a nation's customers ordered, by order status: O is version 1.0, F 2.0 and P 1.5."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    version = F.when(F.col("o_orderstatus") == "O", "1.0").when(F.col("o_orderstatus") == "F", "2.0").otherwise("1.5")
    some = rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("package"), "o_orderstatus", version.alias("version"), F.col("l_partkey").cast("long").alias("key"))
    return some.groupBy("package", F.concat("package", F.lit("@"), "version").alias("release"), "version", "key").agg(F.count("*").alias("users"))


@query(
    "store_replaced",
    """WITH r AS (SELECT c_nationkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 ELSE 2 END AS v, l_partkey AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey),
 b AS (SELECT c_nationkey, max(v) AS v FROM r GROUP BY c_nationkey) SELECT key, count(*) AS users FROM r JOIN b USING (c_nationkey, v) GROUP BY key""",
)
def store_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Releases written one version after another, the newest in the middle: the counts of what is visible in the end."""
    rows = graph.saved(releases(spark, sf))
    kept = store.Store(spark, f"{graph.shared(spark)}/stores/{uuid.uuid4().hex}")
    for version in ("1.0", "2.0", "1.5"):
        own = rows.where(F.col("version") == version)
        kept.replace(own.select("package", "release", "version").distinct(), uses=own.select("package", "release", "key", "users"))
    return store.counted(kept.read("uses", ROWS))
