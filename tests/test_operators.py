"""Operators on small hand-made tables: retrieval, evaluation, graph, counts, streaming."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation, graph, lexical, releases, usage
from siltstone.streaming import state


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "List.map over a list"), (1, "List.zip"), (2, "nothing")], "id long, text string")
    q = spark.createDataFrame([(0, "list map"), (1, "unknown")], "query_id long, text string")
    assert rows_of(lexical.bm25(docs, q), "query_id", "rank", "id") == [(0, 1, 0), (0, 2, 1)]
    assert lexical.bm25(docs.limit(0), q).collect() == []


def test_fusion_keeps_first_seen_order(spark):
    a = spark.createDataFrame([(0, 1, "allow"), (0, 2, "sort")], "query_id long, rank int, id string")
    b = spark.createDataFrame([(0, 1, "sort")], "query_id long, rank int, id string")
    assert rows_of(lexical.fused([a, b]), "rank", "id") == [(1, "sort"), (2, "allow")]
    c = spark.createDataFrame([(0, 1, "zeta")], "query_id long, rank int, id string")
    assert rows_of(lexical.fused([c, a.where("rank = 1")]), "rank", "id") == [(1, "zeta"), (2, "allow")]


def test_max_normalised_and_rerank(spark):
    c = spark.createDataFrame([(0, 1, 1, 8.0), (0, 2, 2, 6.0), (0, 3, 3, 4.0)], "query_id long, rank int, id long, score double")
    assert rows_of(lexical.max_normalised(c), "id", "score") == [(1, 1.0), (2, 0.75), (3, 0.5)]
    assert rows_of(lexical.max_normalised(c.withColumn("score", F.lit(0.0))), "score") == [(0.0,)] * 3
    names = spark.createDataFrame([(0, 2, 1.0), (0, 3, 0.4)], "query_id long, id long, score double")
    assert rows_of(lexical.reranked(c, [(1.0, lexical.max_normalised(c)), (1.0, names)]), "rank", "id") == [(1, 2), (2, 1), (3, 3)]


def test_ndcg(spark):
    from math import log2

    r = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 9)], "query_id long, rank int, id long")
    g = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 7, 0), (1, 5, 3)], "query_id long, id long, grade int")
    got = {x["query_id"]: x for x in evaluation.measures(r, g, 10).collect()}
    assert got[0]["ndcg"] == pytest.approx((1 + 7 / log2(3)) / (7 + 1 / log2(3)), abs=1e-6) and (got[0]["judged"], got[0]["results"]) == (2, 3)
    assert (got[1]["ndcg"], got[1]["results"]) == (0.0, 0)
    kinds = {x["kind"]: x for x in evaluation.by_kind(evaluation.measures(r, g, 10).withColumn("kind", F.col("query_id").cast("string"))).collect()}
    assert kinds["1"]["judged"] == 1.0 and kinds["all"]["queries"] == 2


def test_interval_is_fixed(spark):
    d = spark.createDataFrame([("a", x / 10) for x in range(-5, 10)], "kind string, difference double")
    first, again = evaluation.interval(d, "kind").first(), evaluation.interval(d.orderBy(F.desc("difference")), "kind").first()
    assert first == again and first["low"] < 0.2 < first["high"]


def test_cycles_and_roots(spark):
    e = spark.createDataFrame([("middle", "step"), ("entry", "step"), ("top", "middle"), ("loop", "middle"), ("middle", "loop")], "a string, b string")
    s = spark.createDataFrame([("step",), ("top",)], "start string")
    assert rows_of(graph.roots(e, s), "start", "node") == [("step", "entry"), ("step", "top")]
    assert ("middle", "middle") not in rows_of(graph.reached(e, spark.createDataFrame([("middle",)], "start string")), "start", "node")


def test_changed_counts_equal_a_recount(spark):
    old = spark.createDataFrame([("a", 2), ("b", 1)], "key string, users long")
    change = spark.createDataFrame([("a", -1), ("b", -1), ("c", 3)], "key string, delta long")
    assert rows_of(usage.applied(old, change), "key", "users") == [("a", 1), ("c", 3)]
    assert rows_of(usage.applied(old, change, old.select("key")), "key", "users") == [("a", 1), ("b", 0), ("c", 3)]


def test_bucket():
    waits, tokens, last = [], float(state.BURST), 0.0
    for now in (0.0, 0.0, 0.0, 1.0):
        tokens, wait = state.take(tokens, last, now)
        last = now
        waits.append(wait)
    assert waits == [0.0, 0.0, 1.0, 0.0]


def test_stream_of_changes_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, part in enumerate([[("a", 1), ("b", 2)], [("a", -1), ("c", 5)], [("b", 1)]]):
        spark.createDataFrame(part, "key string, delta long").coalesce(1).write.parquet(f"{source}/p{i}")
    stream = spark.readStream.schema("key string, delta long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    run = state.merged_counts(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch"))
    assert rows_of(state.counts_in(spark, str(tmp_path / "out"), last), "key", "users") == [("a", 0), ("b", 3), ("c", 5)]


def test_changes_of_many_batches_are_added_up(spark, tmp_path):
    for n in range(20):
        rows = spark.createDataFrame([(str(n % 3), n)], "key string, delta long")
        rows.write.parquet(f"{tmp_path}/batch={n}")
        if n == 15:
            state.counts_in(spark, str(tmp_path), 15).write.parquet(f"{tmp_path}/base=15")
    assert rows_of(state.counts_in(spark, str(tmp_path), 19), "key", "users") == [(str(k), sum(n for n in range(20) if n % 3 == k)) for k in range(3)]


def test_a_part_too_large_is_passed_over(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([6, 9, 3, 2, 1])] + [("h", 0, 11), ("h", 1, 10)], "g string, i int, n int")
    assert rows_of(releases.within_budget(rows, "g", ["i"], "n", 10), "g", "i") == [("g", 0), ("g", 2), ("g", 4), ("h", 1)]


def test_stream_limiter_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(c, float(t)) for c in (1, 2) for t in (0, 0, 0, 1, 1, 5)], "client long, at double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # idle timers would keep availableNow going
    stream = state.limited_stream(spark.readStream.schema("client long, at double").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("limited").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows_of(spark.table("limited"), "client", "at", "wait") == rows_of(state.limited(rows), "client", "at", "wait")
