"""Search by cells: recall against the exact search, pruning in the plan, scopes against plain filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import cells, dense
from siltstone.plans.scoped import PROBED
from siltstone.plans.search import vector_queries, vectors

SF = "/root/testdata/sf0.01"


def recall(got, want):
    own = {(r["query_id"], r["id"]) for r in got.collect()}
    every = {(r["query_id"], r["id"]) for r in want.collect()}
    return len(own & every) / len(every)


def test_recall_without_structure(spark):
    v, q = vectors(spark, SF), vector_queries(spark, SF)
    index = cells.built(v)
    got = cells.search(index, v, q, probes=round(PROBED * len(index.centroids)))
    sizes = {r["cell"]: r["count"] for r in index.vectors(v).groupBy("cell").count().collect()}
    assert sum(sizes.values()) == v.count() and len(index.centroids) == int(v.count() ** 0.5)
    assert recall(got, dense.search(v, q)) >= 0.9
    assert cells.search(index, v, q, probes=10**6).exceptAll(dense.search(v, q)).count() == 0


def grouped(spark, n=3000):
    """Vectors around 30 directions."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16))
    x = centres[draw.integers(0, 30, n)] + 0.3 * draw.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(y) for y in x[i]]) for i in range(n)]
    df = spark.createDataFrame([*rows, (n, None)], "id long, v array<double>")
    return rows, df, df.where("id % 97 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def test_structure_needs_few_probes_and_few_files(spark):
    _, v, q = grouped(spark)
    index = cells.built(v, cells=40)
    got = cells.search(index, v, q.where("query_id = 97"), probes=4)
    assert recall(cells.search(index, v, q, probes=4), dense.search(v.where("v is not null"), q)) >= 0.9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan, plan


def test_scopes_are_exact(spark):
    rows, v, q = grouped(spark, 1500)
    payload = [(i, k) for i, _ in rows for k in ("all", f"m{i % 7}", "rare" if i in (5, 700) else "all")] + [(10**6, "all")]
    index = cells.built(v, spark.createDataFrame(payload, "id long, key string"), cells=25)
    ids = v.where("id % 3 = 0").select("id")
    for keys, own, wanted in ((["rare"], None, lambda i: i in (5, 700)), (["all", "m3"], None, lambda i: i % 7 == 3), (["m2"], ids, lambda i: i % 7 == 2 and i % 3 == 0), (None, ids, lambda i: i % 3 == 0), (["m1", "m2"], None, lambda i: False), (["none"], None, lambda i: False)):
        few = {i for i, _ in rows if wanted(i)}
        want = dense.search(v.where(F.col("id").isin(list(few)) & F.col("v").isNotNull()), q) if few else None
        got = cells.search(index, v, q, keys=keys, ids=own)
        assert sorted(map(tuple, got.collect())) == (sorted(map(tuple, want.collect())) if few else [])
    assert {r["cell"] for r in cells.scope(index, ["rare"]).collect()} <= set(range(25)) and cells.scope(index, ["rare"]).count() == 2


def test_bounds_and_empty(spark, monkeypatch):
    _, v, q = grouped(spark, 200)
    none = cells.built(v.limit(0))
    assert cells.search(none, v, q).collect() == []
    monkeypatch.setattr(cells, "MOST", 1)
    with pytest.raises(ValueError, match="queries"):
        cells.search(none, v, q)


@pytest.mark.parametrize("part", [8192, 7])
def test_more_queries_than_one_search_takes(spark, monkeypatch, part):
    """Beyond the bounds of one matrix the rows are the same, with ties, parts of cells and blocks of queries."""
    rows, v, q = grouped(spark, 400)
    v = v.union(v.where("id < 40").select(F.col("id") + 1000, "v"))
    index = cells.built(v, spark.createDataFrame([(i, i % 3) for i, _ in rows], "id long, key int"), cells=12)
    q = v.where("id % 9 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    ids = v.where("id % 2 = 0").select("id")
    want = [cells.search(index, v, q, probes=4).collect(), cells.search(index, v, q, keys=[1], ids=ids).collect(), dense.search(v, q).collect()]
    monkeypatch.setattr(cells, "MOST", 3)
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    monkeypatch.setattr(dense, "VECTOR_PART", part)
    got = [cells.search_many(index, v, q, probes=4), cells.search_many(index, v, q, keys=[1], ids=ids), dense.search(v, q)]
    assert [sorted(map(tuple, x.collect())) for x in got] == [sorted(map(tuple, x)) for x in want]
    assert "CartesianProduct" not in got[2]._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got[2]._jdf.queryExecution().executedPlan().toString()
