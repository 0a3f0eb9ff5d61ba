"""Every operator and stage on odd rows, on empty tables and with clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprints, html_text, language_id, near_dedup, packing, pii, sharding, source_mixing, topk_search, url_filters
from tests.llm.conftest import CLASH


def tables(spark, folder, odd):
    path = str(folder)
    odd.drop(*CLASH).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def folder(odd, tmp_path_factory):
    return tables(None, tmp_path_factory.mktemp("odd"), odd)


@pytest.fixture(scope="session")
def void(empty, tmp_path_factory):
    return tables(None, tmp_path_factory.mktemp("void"), empty)


@pytest.mark.parametrize("op", [source_mixing.op3_source_mixing, sharding.op6_sharding, language_id.op5_language_id, pii.op7_pii, fingerprints.op8_fingerprints, near_dedup.op10_near_dedup])
def test_one_row_per_document(spark, folder, void, odd_rows, op):
    assert len(op(spark, folder).collect()) == len(odd_rows)
    assert op(spark, void).collect() == []


def test_packing(spark, folder, void, odd_rows):
    rows = packing.op4_packing(spark, folder).collect()
    assert len([r for r in rows if r["piece"] == 0]) == len(odd_rows)
    assert packing.op4_packing(spark, void).collect() == []


def test_stages_keep_clashing_columns(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, "")
        assert found.columns == odd.columns, name
        assert all(r[c] == "extra" for r in found.collect() for c in CLASH), name
        assert stage(spark, empty, "").collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() > 0


def test_clashing_columns_of_operators(spark, odd, odd_rows):
    n = len(odd_rows)
    assert sharding.sharded(odd, 3, F.lit(10)).count() == n
    assert language_id.predicted(odd, None).where("lang_pred = 'und'").count() == n
    assert pii.sanitised(odd).columns == odd.columns
    assert fingerprints.fingerprinted(odd).count() == n
    assert near_dedup.near_duplicates(odd).count() == n


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", ""), (None, "no scheme", "<p>x"), (3, "HTTP://A.Example.COM", "<html>" + "<div>" * 5000 + "deep" + "</div>" * 5000)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    judged = {r["page_id"]: r for r in url_filters.judge(pages, labels).collect()}
    assert judged[3]["host"] == "a.example.com" and judged[3]["path"] == "" and judged[3]["rule"] is None and judged[2]["host"] == ""
    assert url_filters.judge(pages, labels.limit(0)).where("verdict = 'allow'").count() == 5
    texts = [r["text"] for r in html_text.extracted(pages.withColumn("text", F.lit(1))).collect()]
    assert sorted(texts) == ["", "", "", "deep", "x"]
    vectors = spark.createDataFrame([(0, [0.5, 0.25]), (50, [0.5, 0.25]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (8, None), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [1.0]), (100, [])], "vec_id long, embedding array<float>")
    x = topk_search.quantised(vectors)
    rows = topk_search.topk(x, x.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 7), (0, 7), (0, 50), (50, 0), (50, 7), (50, 7)]
    assert topk_search.topk(x.limit(0), x.limit(0)).collect() == []
