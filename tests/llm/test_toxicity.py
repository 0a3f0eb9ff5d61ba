"""The tagger of toxic words: exact marginals, gradients, whole query on planted words."""

import itertools
import random
import zlib

import numpy as np

from siltstone.llm import toxicity

PLAIN = ["river", "stone", "light", "paper", "green", "house", "north", "water", "engine", "table", "cloud", "winter", "music", "garden"]


def enumerated(values, starts, moves):
    """All labellings of a chain, one by one."""
    total, toxic, moved = 0.0, np.zeros(len(values)), np.zeros(4)
    for y in itertools.product((0, 1), repeat=len(values)):
        count = np.zeros(4)
        for i, now in enumerate(y):
            if starts[i]:
                count[3] += now
            else:
                count += [y[i - 1] < now, y[i - 1] > now, y[i - 1] and now, 0]
        weight = np.exp(values @ np.array(y) + count @ moves)
        total, toxic, moved = total + weight, toxic + weight * np.array(y), moved + weight * count
    return toxic / total, moved / total, np.log(total)


def test_marginals_are_those_of_all_labellings():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 10):
        values, starts, moves = draw.normal(0, 3, n), draw.random(n) < 0.3, draw.normal(0, 2, 4)
        starts[0] = True
        toxic, moved = toxicity.marginals(values, starts, moves)
        want, want_moved, _ = enumerated(values, starts, moves)
        assert np.allclose(toxic, want) and np.allclose(moved, want_moved)


def test_segments_change_nothing(monkeypatch):
    draw = np.random.default_rng(4)
    for n in (63, 64, 65, 5000, 70_001):
        values, starts, moves = draw.normal(-2, 8, n), draw.random(n) < 0.01, np.array([1.0, -1.0, 2.0, 0.5])
        starts[0] = True
        monkeypatch.setattr(toxicity, "SEGMENT", 64)
        got = toxicity.marginals(values, starts, moves)
        monkeypatch.setattr(toxicity, "SEGMENT", 10**9)
        assert all(np.allclose(a, b) for a, b in zip(got, toxicity.marginals(values, starts, moves), strict=True))


def test_steps_climb_the_likelihood():
    texts = ["river vilest stone", "stone river light", "vilely paper green house", "green light"]
    shard = toxicity.Shard(texts, [True, False, True, False], {"vile*"})
    assert shard.y.tolist() == [False, True, False] + [False] * 3 + [True] + [False] * 5

    def likelihood(weights, moves):
        whole = np.zeros(toxicity.WEIGHTS)
        whole[shard.used] = weights
        out = 0.0
        for text, marks in zip(texts, ([0, 1, 0], [0, 0, 0], [1, 0, 0, 0], [0, 0]), strict=True):
            own = [toxicity.features(w) for w in text.split()]
            value = np.array([sum(whole[p] for p in f[0]) for f in own])
            value[1:] += [whole[f[1]] for f in own[:-1]]
            value[:-1] += [whole[f[2]] for f in own[1:]]
            starts = np.arange(len(own)) == 0
            counts = [sum(a < b for a, b in itertools.pairwise(marks)), sum(a > b for a, b in itertools.pairwise(marks)), 0, marks[0]]
            out += value @ np.array(marks) + np.array(counts) @ moves - enumerated(value, starts, moves)[2]
        return out

    scores = [likelihood(*shard.fit(np.zeros(toxicity.WEIGHTS), np.zeros(4), steps)) for steps in (0, 5, 20, 60)]
    assert scores[0] < -5 and min(scores[1:]) > -0.5  # nearly all of what can be explained


def corpus(n=900, seed=7):
    """Documents of which a fifth hold forms of two stems, never seen whole in the others."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        own = [draw.choice(PLAIN) + str(draw.randint(0, 40)) for _ in range(draw.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(draw.randint(2, 4)):
                own.insert(draw.randrange(len(own) + 1), draw.choice(["grumble", "snarl"]) + draw.choice(["", "ing", "ed", "er", "ish", "some"]))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_query_finds_planted_words(spark, tmp_path):
    rows = corpus()
    extra = [(5000, None), (5001, ""), (5002, "... !!"), (None, "grumbling snarlish"), (5003, "river stone " * 40_000), (5004, ("river " * 20_000) + "snarling grumbler"), (5004, ("river " * 20_000) + "snarling grumbler")]
    spark.createDataFrame([*[r[:2] for r in rows], *extra], "doc_id long, text string").selectExpr("*", "'x' as toxic", "1 as score", "2 as number").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, t) for i, _, t in rows if i % 4] + [(0, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {i: t for i, _, t in rows} | {5000: 0, 5001: 0, 5002: 0, 5003: 0, 5004: 1, None: 1}
    wrong = [r for r in found if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.01 * len(rows) and not [r for r in wrong if r["doc_id"] is None or r["doc_id"] >= 5000], wrong
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_spans_and_no_labels(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    some = spark.createDataFrame([(1, "The river, snarling grumbled stone"), (2, "river"), (3, None)], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in toxicity.tagged(some, model).collect()}
    assert spans == {1: [(11, 28)], 2: [], 3: []}
    none = toxicity.fit(docs, labels.limit(0))
    assert not none.learned and {r["score"] for r in toxicity.scored(some, none).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).collect() == []
    alike = toxicity.fit(docs, labels.withColumn("toxic", labels.doc_id * 0 + 1))
    assert {r["score"] for r in toxicity.scored(some, alike).collect()} == {1.0}
