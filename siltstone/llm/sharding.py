"""Sharding by a two-pass external shuffle. DataFrame functions only.

Pass 1 scatters the records: rendezvous hashing of doc_id gives the shard (the largest of one seeded hash per shard), a second seeded hash
gives one of the shard's buckets, as many as the shard's own bytes need for a bucket to fit in memory, and the whole records are dealt out by bucket. Pass 2 shuffles each bucket
by Fisher-Yates (Spark's `shuffle` of the bucket's array) and writes it; a slot is the bucket's first slot plus the place in the bucket.

Law `key`: doc_id and the shard count decide alone. With one more shard a row moves only if the new shard's hash is the largest, so rows go
only into the new shard. Rows of one doc_id share a shard, but not a bucket: the bucket's hash takes the row's number in the scan as well.

The op6 query shuffles and writes whole documents, and takes sizes and checksums from the written shards.

Null doc_id: hashed like any other value. Null text: 8 bytes, CRC of nothing. Empty tables: no rows. Buckets have an expected size: hashes
are uniform, so a bucket is beyond twice the wanted rows with vanishing probability.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from siltstone.llm.shared import Scratch, partitions, read, shared_folder, staged


def shard_of(key: Column, shards: int, seed: int = 23) -> Column:
    """The shard by rendezvous hashing."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("h"), s.alias("s")))
    return F.array_max(hashes)["s"].cast("int")


def sharded(docs: DataFrame, shards: int, bytes_of: Column, bucket_bytes: int = 32 << 20, seed: int = 23, stage=staged) -> DataFrame:
    """docs with shard and slot added, in the order of a shuffle of every shard.

    All columns travel through the buckets, maps as well; columns of docs named shard or slot give way. `stage` writes the buckets."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    least = max(1, math.ceil(partitions(spark) / shards))
    shard = shard_of(F.col("doc_id"), shards, seed)
    weights = docs.groupBy(shard.alias("of")).agg(F.sum(bytes_of).alias("bytes")).collect()
    counts = [least] * shards
    for r in weights:
        counts[r["of"]] = max(least, math.ceil((r["bytes"] or 0) / bucket_bytes))
    firsts = [sum(counts[:s]) for s in range(shards)]
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    scattered = docs.select(F.struct(*columns).alias("record"), shard.alias("shard"), F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed + 1)).alias("draw"))
    dealt = scattered.withColumn("at", (of_shard(firsts) + F.pmod(F.col("draw"), of_shard(counts))).cast("int")).repartition(max(partitions(spark), sum(counts)), "at")  # about one bucket in a task's memory
    if "map<" in docs.schema.simpleString():  # maps have no order: records go by their draw
        by_draw = lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).otherwise(0)
        records = F.transform(F.array_sort(F.collect_list(F.struct("draw", "record")), by_draw), lambda r: r["record"])
    else:
        records = F.sort_array(F.collect_list("record"))
    gathered = dealt.groupBy("at", "shard").agg(records.alias("records")).sortWithinPartitions("at")
    mixed = stage(gathered.select("at", "shard", F.shuffle("records", seed).alias("records")))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(mixed.select("at", "shard", F.size("records").alias("n")).select("at", first.alias("first")))
    placed = mixed.join(starts, "at").select("shard", "first", F.posexplode("records").alias("place", "record"))
    return placed.select("record.*", "shard", (F.col("first") + F.col("place")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int, bytes_of: Column, **options) -> None:
    """Writes docs as one sub-folder of Parquet files per shard; `slot` holds each record's place in its shard."""
    with Scratch(docs.sparkSession) as stage:
        sharded(docs, shards, bytes_of, stage=stage, **options).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The records of written shards, with shard and slot. docs: what was written."""
    kept = [f for f in docs.schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(StructType([*kept, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(folder)


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bytes_of = lambda text: (F.octet_length(text) + 8).cast("long")
    folder = f"{shared_folder(spark)}/shards/{uuid.uuid4().hex}"
    write_shards(docs, folder, shards, bytes_of(F.coalesce(F.col("text"), F.lit(""))))
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    out = read_shards(spark, folder, docs)
    return out.select("doc_id", bytes_of(text).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
