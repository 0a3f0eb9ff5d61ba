"""Streaming: merged counts by micro-batch, answers kept by digest, windowed counts, and a token bucket per client.

Each has a batch form with the same result; tests hold them equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the limiter: requests a minute and the burst.
PER_MINUTE, BURST = 60, 2
IDLE_MS = 3_600_000


def take(tokens: float, last: float, now: float, per_minute: float = PER_MINUTE, burst: float = BURST) -> tuple[float, float]:
    """Tokens after a request at `now`, and the wait in seconds (0 if it is let through)."""
    tokens = min(burst, tokens + (now - last) * per_minute / 60)
    return (tokens - 1, 0.0) if tokens >= 1 else (tokens, (1 - tokens) * 60 / per_minute)


def limited_stream(requests: DataFrame) -> DataFrame:
    """requests: client long, at double (seconds). One bucket per client; client, at and wait of each request; idle clients' state expires."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        every = pd.concat(list(batches)).sort_values("at", kind="stable")
        tokens, last = held.get if held.exists else (float(BURST), float(every["at"].iloc[0]))
        waits = []
        for now in every["at"]:
            tokens, wait = take(tokens, last, now)
            last = now
            waits.append(wait)
        held.update((float(tokens), float(last)))
        held.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"client": [key[0]] * len(waits), "at": every["at"].to_list(), "wait": waits})

    return requests.groupBy("client").applyInPandasWithState(fold, "client long, at double, wait double", "tokens double, last double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def limited(requests: DataFrame) -> DataFrame:
    """The same over a table: clients' requests in order stream through a fold that carries one bucket, so memory is a batch whatever a client's history."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, 0.0, 0.0
        for batch in batches:
            waits = []
            for c, now in zip(batch["client"], batch["at"], strict=True):
                if c != client:
                    client, tokens, last = c, float(BURST), now
                tokens, wait = take(tokens, last, now)
                last = now
                waits.append(wait)
            yield batch.assign(wait=waits)

    return requests.select("client", "at").repartition("client").sortWithinPartitions("client", "at").mapInPandas(fold, "client long, at double, wait double")


#: Batches of changes that are read one by one, before they become a base of their own.
TOGETHER = 16


def merged_counts(changes: DataFrame, folder: str, checkpoint: str):
    """A stream of signed changes (key, delta) kept as counts; returns the started query. counts_in() reads them.

    Each micro-batch writes its own sums by key, under its number, so that a batch that runs again writes the same again, and the table isn't
    rewritten. Every TOGETHER-th batch adds all so far up to a new base. Keys whose changes add up to 0 stay, with 0 users.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.groupBy("key").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number % TOGETHER == TOGETHER - 1:
            _added(spark, folder, number).write.mode("overwrite").parquet(f"{folder}/base={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _added(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """key and users after a batch: the last base before it and the batches since."""
    first = number // TOGETHER * TOGETHER
    rows = spark.read.parquet(*[f"{folder}/batch={n}" for n in range(first, number + 1)]).select("key", "delta")
    if first:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/base={first - 1}").select("key", F.col("users").alias("delta")))
    return rows.groupBy("key").agg(F.sum("delta").alias("users"))


def counts_in(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The counts that merged_counts has written, as they are after a batch."""
    return _added(spark, folder, number)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def read_through(texts: DataFrame, folder: str, checkpoint: str, ask: Callable[[DataFrame], DataFrame]):
    """A stream of `text`, each different one answered once; returns the started query. answers_in() reads the answers.

    ask: from (digest, text) to (digest, value), such as a model by Arrow batches. A micro-batch asks for its distinct texts that no earlier batch
    has stored, and writes the answers under its number. A batch that runs again is passed over if its answers are whole, and else written anew. Null
    texts ask nothing. folder and checkpoint belong together.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{folder}/batch={number}"
        if _exists(spark, f"{path}/_SUCCESS"):
            return
        wanted = batch.where("text is not null").select(digest(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])
        if _exists(spark, f"{folder}/batch=0/_SUCCESS"):
            wanted = wanted.join(answers_in(spark, folder).where(F.col("batch") < number).select("digest"), "digest", "left_anti")
        ask(wanted).select("digest", "value").write.mode("overwrite").parquet(path)

    return texts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_in(spark: SparkSession, folder: str) -> DataFrame:
    """digest, value and the batch that asked, of all that read_through has written; the batches are partitions."""
    return spark.read.parquet(folder)


def asked_by_batch(requests: DataFrame) -> DataFrame:
    """The same over a table (batch, text): requests, texts asked for and texts found, by batch. A text is asked for in the first batch that has it."""
    rows = requests.where("text is not null").select("batch", digest(F.col("text")).alias("digest"))
    each = rows.groupBy("batch", "digest").agg(F.count("*").alias("n"))
    first = F.min("batch").over(Window.partitionBy("digest"))
    asked = F.sum((F.col("first") == F.col("batch")).cast("long"))
    return each.withColumn("first", first).groupBy("batch").agg(F.sum("n").alias("requests"), asked.alias("asked"), (F.count("*") - asked).alias("found"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per window and type, with a watermark; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
