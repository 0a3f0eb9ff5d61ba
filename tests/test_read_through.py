"""A stream of texts asks for each different text once, whatever runs again."""

import shutil

from pyspark.sql import functions as F

from siltstone.streaming import state

BATCHES = [["a", "b", "a", None], ["b", "c"], ["c", "a"], ["d", "", "d"]]


def test_read_through(spark, tmp_path):
    source, folder, asked = str(tmp_path / "in"), str(tmp_path / "kept"), []

    def ask(texts):
        asked.append(sorted(r["text"] for r in texts.collect()))
        return texts.select("digest", F.length("text").alias("value"))

    def run(checkpoint):
        stream = spark.readStream.schema("text string").parquet(source)
        state.read_through(stream, folder, str(tmp_path / checkpoint), ask).awaitTermination()

    for texts in BATCHES:
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(source)
        run("one")
    assert asked == [["a", "b"], ["c"], [], ["", "d"]]
    rows = spark.createDataFrame([(n, t) for n, texts in enumerate(BATCHES) for t in texts], "batch int, text string")
    by_batch = {r["batch"]: r for r in state.asked_by_batch(rows).collect()}
    assert [by_batch[n]["asked"] for n in range(4)] == [len(a) for a in asked] and by_batch[0]["requests"] == 3 and by_batch[2]["found"] == 2
    kept = lambda: sorted((r["digest"], r["value"], r["batch"]) for r in state.answers_in(spark, folder).collect())
    whole = kept()
    assert len({d for d, *_ in whole}) == len(whole) == 5
    asked.clear()
    shutil.rmtree(tmp_path / "one" / "commits")  # the batches were answered but not committed
    run("one")
    assert asked == [] and kept() == whole
    (tmp_path / "kept" / "batch=3" / "_SUCCESS").unlink()  # and one had not been written to its end
    shutil.rmtree(tmp_path / "one" / "commits")
    run("one")
    assert asked == [["", "d"]] and kept() == whole
