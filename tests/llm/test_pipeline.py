import json

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF).collect()
    used = {r["sequence_id"] for r in found}
    assert found and all(0 < r["length"] <= 4096 for r in found)
    assert len(used) <= 1.1 * -(-sum(r["length"] for r in found) // 4096) + 1
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_near_stage_keeps_one_of_each_group(spark):
    rows = [(i, "the same words in each of these texts here " * 3, "en", "s", 1) for i in range(40)] + [(100, "quite another text with its own words only", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == [0, 100]


def test_personal_data_stage(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.com now", "en", "s", 28), (2, "nothing here", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert found[1]["text"] == "write to [EMAIL] now" and found[1]["n_chars"] == 20 and found[2]["text"] == "nothing here"


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = docs.limit(1).withColumn("text", F.lit("### 123 ***")).withColumn("doc_id", F.lit(10**6))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(junk), SF).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}, json.dumps(len(kept))
