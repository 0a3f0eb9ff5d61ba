"""The use graph: who is reached, roots, helpers, parents. Closures run as rounds of joins that stop when nothing new comes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: each round of a loop starts from a table."""
    spark = df.sparkSession
    path = f"{shared(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own(spark)).rstrip("/")


def _own(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): all nodes that each start reaches, itself left out even if a cycle comes back. edges: a, b; starts: start."""
    steps = saved(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    front = saved(starts.join(steps, F.col("start") == F.col("a")).select("start", F.col("b").alias("node")).where("start <> node").distinct())
    found = front
    while not front.isEmpty():
        onward = front.join(steps, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).where("start <> node").distinct()
        front = saved(onward.join(found, ["start", "node"], "left_anti"))
        found = found.unionByName(front)
    return found


def roots(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): the reached nodes that nothing leads on from, walking from the used to its users."""
    users = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return reached(users, starts).join(users.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("start", "node")


def helpers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """id, helper: whether a transitive user's name, with a dot, begins the node's name. names: id, name."""
    users = reached(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), names.select(F.col("id").alias("start")))
    own, other = names.select(F.col("id").alias("start"), "name"), names.select(F.col("id").alias("node"), F.col("name").alias("user_name"))
    inside = users.join(own, "start").join(other, "node").where(F.col("name").startswith(F.concat("user_name", F.lit("."))))
    return names.join(inside.select(F.col("start").alias("id"), F.lit(True).alias("h")).distinct(), "id", "left").select("id", "name", F.coalesce("h", F.lit(False)).alias("helper"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node with its sorted distinct users and uses."""
    uses = edges.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("uses"))
    users = edges.groupBy(F.col("b").alias("node")).agg(F.array_sort(F.collect_set("a")).alias("users"))
    none = F.array().cast("array<bigint>")
    return uses.join(users, "node", "full").select("node", F.coalesce("uses", none).alias("uses"), F.coalesce("users", none).alias("users"))


def coded(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionary encoding: the code of each distinct value within its key, in order of the values."""
    table = rows.select(key, value).distinct().withColumn("code", F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1)
    return rows.join(table, [key, value])
