"""Matches across lines against a plain search; line numbers across splits; intervals of many groups."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import blocks, evaluation
from siltstone.sources import lines


def texts(n=200, seed=3):
    draw = random.Random(seed)
    return [(i, "".join(draw.choice(["ab", "a", "b", "x", "\n", "\n\n", " ", "é", "🙂", "﷐", "B"]) for _ in range(draw.randint(0, 40)))) for i in range(n)] + [(900, None), (901, ""), (902, "a\n" * 3000 + "b")]


def plain_spans(text, pattern):
    text = (text or "").replace("﷐", "�")
    for m in re.finditer(f"(?s){pattern}", text):
        if m[0]:
            first = text.count("\n", 0, m.start()) + 1
            yield m.start(), m.end(), first, first + m[0].count("\n") - m[0].endswith("\n")


def test_spans_and_contexts(spark):
    docs = spark.createDataFrame(texts(), "id long, text string")
    for pattern in (r"a\n+b", r"b.x", r"(?i)B\n", r"a(b|x)+", r"é|🙂"):
        want = sorted((i, *s) for i, t in texts() for s in plain_spans(t, pattern))
        assert sorted(tuple(r) for r in blocks.match_spans(docs, pattern).collect()) == want, pattern
        shown = []
        for i, t in texts():
            own = (t or "").removesuffix("\n").split("\n") if t else []
            spans = [(f, min(e, len(own))) for _, _, f, e in plain_spans(t, pattern)]
            hit = {k for f, e in spans for k in range(f, e + 1)}
            near = sorted({k for f, e in spans for k in range(max(1, f - 2), min(len(own), e + 1) + 1)})
            island = 0
            for k, line in enumerate(near):
                island += k > 0 and line - near[k - 1] > 1
                shown.append((i, line, line in hit, island, own[line - 1]))
        assert sorted(tuple(r) for r in blocks.grep_spans(docs, pattern, 2, 1).collect()) == sorted(shown), pattern


def test_pattern_of_nothing(spark):
    with pytest.raises(ValueError, match="empty"):
        blocks.match_spans(spark.createDataFrame(texts(3), "id long, text string"), "x?")


def test_numbers_across_splits(spark, tmp_path):
    bad = {1: "{", 4321: "[1]", 4322: '{"id": "x"}', 9000: "word", 9999: '{"id": 1'}
    for name, count in (("a.jsonl", 10_000), ("b.jsonl", 10)):
        with open(f"{tmp_path}/{name}", "w") as out:
            for i in range(1, count + 1):
                out.write(("" if i % 1000 == 7 else bad.get(i) or json.dumps({"id": i, "text": "é" * (i % 50)})) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = lines.json_lines(spark, str(tmp_path), "id long, text string")
        assert lines.numbered(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1
        found = rows.withColumn("file", F.regexp_extract("file", r"(\w\.jsonl)$", 1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = {(r["file"], r["line"]): r["row"]["id"] for r in found if r["problem"] is None}
    want = {(f, i): i for f, n in (("a.jsonl", 10_000), ("b.jsonl", 10)) for i in range(1, n + 1) if i % 1000 != 7 and i not in bad}
    assert good == want
    assert sorted((r["line"], r["problem"]) for r in found if r["problem"]) == sorted((i, f"line {i}: not a record") for i in [1, *bad])


def test_poisson_resamples(spark):
    draw = np.random.default_rng(5)
    rows = [(k, i, float(draw.normal(k, 1))) for k in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id long, difference double").withColumn("key", F.concat_ws("/", "g", "id"))
    found = {r["g"]: (r["low"], r["high"]) for r in evaluation.poisson_interval(df, "g", "key", 400).collect()}
    again = {r["g"]: (r["low"], r["high"]) for r in evaluation.poisson_interval(df.repartition(9), "g", "key", 400).collect()}
    for k in range(3):
        own = np.array([x for g, _, x in rows if g == k])
        half = 1.96 * own.std() / np.sqrt(len(own))
        assert np.allclose(found[k], again[k]) and abs(found[k][0] - (own.mean() - half)) < 0.04 and abs(found[k][1] - (own.mean() + half)) < 0.04
    times = df.select(evaluation.drawn(F.col("key"), F.lit(1)).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(times[0] - 1) < 0.1 and abs(times[1] - 1) < 0.15
