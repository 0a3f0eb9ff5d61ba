"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet in the shared folder and reread as the next one's documents; what the stage before had written is then removed.
All but the last return the columns of documents. Decisions are made on light rows and meet the texts by the rows' places in their files.

language: documents of no known language go (no letter, or a calibrated score below MIN_SCORE).
near_duplicates: one document of each group of near-copies stays (five-word shingles, similarity 0.8).
personal_data: personal data are replaced in the texts; n_chars follows.
mixing: documents are repeated or left out towards the sources' target weights; a document taken twice is two rows.
packing: the pieces of the documents, each with its token ids, its sequence and its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language_id, near_dedup, packing, pii, source_mixing
from siltstone.llm.shared import Scratch, numbered, read

#: Below this share no language is likely; with as few as three languages a guess has a third.
MIN_SCORE = 0.4
#: Words whose ids a Python worker keeps for packing: fewer than alone, since workers also hold what the earlier stages left.
WORDS_KEPT = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known(docs, language_id.fit(docs), MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, size=5).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    with Scratch(spark) as stage:
        light = stage(rows.select("uid", "row.doc_id", "row.source", source_mixing.words(F.col("row.text")).alias("size")))
        times = source_mixing.repetitions(light, source_mixing.targets(light)).where("times > 0").select("uid", "times")
    # merged: the repetitions take little room on disk for their number, so Spark would broadcast them
    return rows.join(times.hint("merge"), "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(docs, kept=WORDS_KEPT)).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packed)]

#: Hashed n-grams, min-max hashing and byte-pair encoding are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = Scratch(spark)
        docs = folder(stage(spark, docs, sf_dir))
        if before:
            before.__exit__()
        before = folder
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing stages its pieces: nothing reads docs any more
    before.__exit__()
    return out
