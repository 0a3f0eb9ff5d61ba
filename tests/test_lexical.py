"""BM25 by batches of documents: equal to the sums that are shuffled, whatever the bounds, and only the best leave a batch."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical


def tables(spark):
    docs = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 2 + i % 5)) + (" List.map" if i % 3 == 0 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), *((200 + i, "w1 w2 listMap") for i in range(20))]
    asked = [(0, "w1 w2 w3 w1"), (1, "list map"), (2, "unknown"), (3, None), (4, "w5 listMap unknown")]
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("sums", [1 << 21, 9])
def test_batches_equal_shuffled_sums(spark, monkeypatch, sums):
    docs, q = tables(spark)
    monkeypatch.setattr(lexical, "SUMS", sums)
    found = lexical.index(docs)
    got = {n: lexical.bm25(found, q, n) for n in (3, 10, 1000)}
    assert "MapInArrow" in got[3]._jdf.queryExecution().executedPlan().toString()
    got = {n: sorted(map(tuple, df.collect())) for n, df in got.items()}
    monkeypatch.setattr(lexical, "ASKED", 0)
    for n, rows in got.items():
        assert rows and rows == sorted(map(tuple, lexical.bm25(found, q, n).collect()))


def test_scores_of_pairs(spark):
    docs, q = tables(spark)
    found = lexical.index(docs)
    pairs = spark.createDataFrame([(0, 3), (0, 205), (1, 3), (2, 3), (4, 999)], "query_id long, id long")
    want = lexical.scores(found, q).join(pairs, ["query_id", "id"], "left_semi")
    assert sorted(map(tuple, lexical.scores(found, q, pairs).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == 3 and lexical.bm25(found, q.where("query_id = 2")).where(F.lit(True)).collect() == []


def test_texts_are_counted_in_batches(spark, monkeypatch):
    """No row a word is grouped; rows equal the counts by columns, also where an id stands in several rows."""
    monkeypatch.setattr(lexical, "TEXTS", 40)
    odd = ["HTTPServer2x parseJSON", "a-b.c_d A-b", "x1y2 ABCDef ABCdef", "__init__ --", "Ünï cöde straße", "9lives R2D2 R2-D2", "a\nB\r\nc a", "List.map List_map listMap listmap"]
    docs, _ = tables(spark)
    docs = docs.unionByName(spark.createDataFrame([(300 + i, t) for i, t in enumerate(odd)], "id long, text string"))
    assert "Aggregate" not in lexical._counted(docs)._jdf.queryExecution().executedPlan().toString()
    for rows in (docs, docs.unionByName(spark.createDataFrame([(200, "w1 more"), (300, "w1"), (300, None)], "id long, text string"))):
        found = lexical.index(rows).documents
        got = {(r["id"], t): n for r in found.collect() for t, n in zip(r["terms"], r["tfs"], strict=True)}
        assert got == {(r["id"], r["term"]): r["tf"] for r in lexical.term_counts(rows).collect()}
        assert found.groupBy("id").count().where("count > 1").isEmpty()
        assert all(r["length"] == sum(r["tfs"]) for r in found.collect())
