import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.library import Filters, Library
from siltstone.operators import tables
from siltstone.sources import files


@pytest.fixture(scope="module")
def library(spark):
    rows = [("a", "kit", "kit/main.x", "sort list\nby key"), ("b", "kit", "kit/sub/two.x", "map a list"), ("c", "app", "app/main.x", "use sort\n\nand map\nend")]
    edges = [("c", "a"), ("c", "b"), ("b", "a")]
    return Library(spark.createDataFrame(rows, "id string, package string, path string, text string"), spark.createDataFrame(edges, "a string, b string"))


def test_search(library):
    assert library.search("sort list").orderBy("rank").first()["id"] == "a"
    assert {r["id"] for r in library.search("list").collect()} == {"a", "b"}
    assert [r["id"] for r in library.search("list", Filters(used_by=["c"], uses=["a"])).collect()] == ["b"]
    assert [(r["id"], r["users"]) for r in library.search(filters=Filters(packages=["kit"])).collect()] == [("a", 2), ("b", 1)]
    assert library.search("list", Filters(packages=["kit", "app"])).collect() == []
    with pytest.raises(ValueError, match="words or filters"):
        library.search()


def test_files_and_lines(library):
    assert [(r["path"], r["total"]) for r in library.files("main.x").collect()] == [("app/main.x", 2), ("kit/main.x", 2)]
    assert [r["path"] for r in library.files("/kit/**", "!two.x").collect()] == ["kit/main.x"]
    assert [(r["line"], r["hit"]) for r in library.grep("map", "/app/*", before=1).orderBy("line").collect()] == [(2, False), (3, True)]
    assert [r["content"] for r in library.read("app/main.x", 3, 4).orderBy("line").collect()] == ["and map", "end"]
    one = library.definition("a").first()
    assert (one["users"], one["uses"]) == (["b", "c"], [])


def test_manifests(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(1, f"{digest} src/a.x\n{digest} ../b.x\nshort c.x\n")], "id long, text string")
    assert [(r["path"], r["valid"]) for r in files.manifest_entries(rows).collect()] == [("src/a.x", True), ("../b.x", False), ("c.x", False)]


def test_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.x").write_bytes(b"ok \xff end")
    assert [r["text"] for r in files.texts(spark, str(tmp_path)).collect()] == ["ok � end"]


def test_generations(spark):
    rows = spark.createDataFrame([("c", 1, True), ("c", 2, True), ("c", 3, False), ("d", 1, False)], "corpus string, n long, ok boolean")
    got = {(r["corpus"], r["n"]): r["state"] for r in tables.promoted(rows, "corpus", "n", F.col("ok")).collect()}
    assert got == {("c", 1): "retired", ("c", 2): "live", ("c", 3): "building", ("d", 1): "building"}
