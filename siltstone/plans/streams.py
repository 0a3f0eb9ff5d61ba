"""Queries whose streaming form has the same result over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources.tables import table
from siltstone.streaming import state


@query(
    "token_bucket",
    """WITH RECURSIVE r AS (SELECT user_id AS client, epoch_us(ts) / 1e6::DOUBLE AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT client, "at", n, 2.0::DOUBLE AS before FROM r WHERE n = 1 UNION ALL
  SELECT r.client, r."at", r.n, least(2.0::DOUBLE, (CASE WHEN f.before >= 1 THEN f.before - 1 ELSE f.before END) + (r."at" - f."at")) FROM f JOIN r ON r.client = f.client AND r.n = f.n + 1)
 SELECT client, round("at", 6) AS "at", round(CASE WHEN before >= 1 THEN 0.0 ELSE 1 - before END, 6) AS wait FROM f""",
)
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    found = state.limited(table(spark, sf, "events").select(F.col("user_id").alias("client"), at.alias("at")))
    return found.select("client", F.round("at", 6).alias("at"), F.round("wait", 6).alias("wait"))


@query("windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.windowed_counts(rows).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    "search_log_sessions",
    """SELECT conv_id, count(*) AS searches, count(DISTINCT role) AS roles, sum(length(text)) AS characters, max(turn) AS last FROM conversations GROUP BY conv_id""",
)
def search_log_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id")
    return rows.agg(F.count("*").alias("searches"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("characters"), F.max("turn").alias("last"))


@query(
    "read_through_batches",
    """WITH e AS (SELECT turn AS batch, text, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL), f AS (SELECT *, min(batch) OVER (PARTITION BY text) AS first FROM e)
 SELECT batch, CAST(sum(n) AS BIGINT) AS requests, count(*) FILTER (first = batch) AS asked, count(*) FILTER (first < batch) AS found FROM f GROUP BY batch""",
)
def read_through_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What a read-through cache asks for if the conversations come turn by turn; tests hold the stream equal."""
    return state.asked_by_batch(table(spark, sf, "conversations").select(F.col("turn").alias("batch"), "text"))
