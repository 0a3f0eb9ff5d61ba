"""Helpers shared by the operators of this subpackage: tables in the shared folder, row numbers, exact global order, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from types import TracebackType

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine gets a temporary one; a cluster gets an error."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def staged(df: DataFrame, under: str = "staged") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, and gives Spark the true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{under}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that live no longer than a block: `with Scratch(spark) as staged`. Leaving it removes them from the shared folder.

    Results that are still to be read go through the function `staged` instead."""

    def __init__(self, spark: SparkSession):
        self.spark, self.under = spark, f"scratch/{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return staged(df, self.under)

    def append(self, df: DataFrame, name: str) -> None:
        """Adds rows to a table of this block, which rounds of a loop fill."""
        df.write.mode("append").parquet(f"{shared_folder(self.spark)}/{self.under}/{name}")

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{shared_folder(self.spark)}/{self.under}/{name}")

    def __exit__(self, kind: type | None = None, error: BaseException | None = None, trace: TracebackType | None = None) -> None:
        removed(self.spark, f"{shared_folder(self.spark)}/{self.under}")


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, on whatever file system it lies, and lets Spark's cleaner find the plans that went with it, whose shuffle files then go as well."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()


#: What a plan may hold for a row's place in its file to tell it apart: it neither multiplies rows nor reads a file twice.
PLAIN = {"Relation", "RelationV2", "Project", "Filter", "SubqueryAlias", "View"}


def _plain(docs: DataFrame) -> bool:
    """Whether docs is one reading of files, at most filtered and projected; what isn't known to be one counts as none."""
    steps = [line.lstrip(" :+-!'") for line in docs._jdf.queryExecution().analyzed().toString().splitlines()]
    return all(re.match(r"\w*", step)[0] in PLAIN for step in steps if step)


def numbered(docs: DataFrame) -> DataFrame:
    """`row` (all columns of docs in a struct) and `uid`, a struct that tells the rows apart.

    Of a table as read from Parquet it is the row's file and place there, so nothing is written and every later reading gives the same. What has
    no such place, or may have multiplied its rows after reading (exploded, joined, united), is staged first."""
    whole = F.struct(*docs.columns).alias("row")
    if not _plain(docs):
        return numbered(staged(docs))
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(whole, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")).alias("uid"))
    except AnalysisException:
        return numbered(staged(docs))


def by_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas for rows with long texts: Arrow batches of at most BATCH_ROWS rows, so that a worker holds few of them. The limit is a setting of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.mapInPandas(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, name: str, stage=staged) -> DataFrame:
    """Adds a 0-based global position by `order`, with no single-task sort: range partitions, then offsets by partition.

    The offsets are one row per partition, so their window and broadcast don't grow with the rows.
    """
    n = partitions(df.sparkSession)
    part = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = part.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_offset"))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_in")).drop("_part", "_in", "_offset")


def unit(*columns) -> F.Column:
    """A uniform number in [0, 1) from a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
