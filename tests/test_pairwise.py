"""Learning from pairs: gradients against every pair one by one, trees on planted preferences, folds."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import evaluation, learned, pairwise


def plain_gradients(scores, grades, truncation):
    n = len(scores)
    order = sorted(range(n), key=lambda i: -scores[i])
    place = {i: k for k, i in enumerate(order)}
    ideal = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted(grades, reverse=True)))
    push, curve = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if ideal and grades[i] > grades[j] and min(place[i], place[j]) < truncation:
                change = abs((2 ** grades[i] - 2 ** grades[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / ideal
                wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
                for at, sign in ((i, 1), (j, -1)):
                    push[at] += sign * change * wrong
                    curve[at] += change * wrong * (1 - wrong)
    return push, curve


def test_gradients_are_those_of_all_pairs(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for q in range(6):
        n = draw.randint(1, 30)
        scores, grades = [draw.choice([0.0, 0.5, draw.random()]) for _ in range(n)], [draw.choice([0, 0, 1, 3]) if q else 0 for _ in range(n)]
        for truncation in (3, 20):
            got = pairwise.gradients(np.array(scores), np.array(grades, float), truncation)
            assert np.allclose(got, plain_gradients(scores, grades, truncation))
        rows += [(q, i, s, g) for i, (s, g) in enumerate(zip(scores, grades, strict=True))]
        want |= {(q, i): (a, b) for i, (a, b) in enumerate(zip(*plain_gradients(scores, grades, 3), strict=True))}
    found = pairwise.pair_gradients(spark.createDataFrame(rows, "query_id long, id long, score double, grade int"), 3).collect()
    assert len(found) == len(rows) and all(np.allclose((r["push"], r["curve"]), want[r["query_id"], r["id"]]) for r in found)


def candidates(spark, queries=60, depth=30):
    """The grade follows a feature relative to the query and an interaction; a constant of the query misleads a regression on the gain."""
    draw = random.Random(9)
    rows = []
    for q in range(queries):
        shift = draw.gauss(0, 5)
        for i in range(depth):
            a, b, noise = draw.random(), draw.random(), draw.random()
            worth = a + (0.8 if b > 0.7 and a > 0.3 else 0.0) + 0.1 * noise
            rows.append((q, i, q % 5, 3 if worth > 1.5 else 1 if worth > 1.1 else None, a, b, noise, None if i % 7 == 0 else shift, float("nan") if i % 5 == 0 else shift * a))
    return spark.createDataFrame(rows, "query_id long, id long, fold int, grade int, a double, b double, noise double, shift double, mixed double")


def ndcg(found, rows):
    grades = rows.where("grade is not null").select("query_id", "id", "grade")
    return evaluation.measures(found, grades, 10).agg(F.avg("ndcg")).first()[0]


def test_pairs_rank_better_than_regression(spark):
    rows, names = candidates(spark), ["a", "b", "noise", "shift", "mixed"]
    found = pairwise.cross_ranked(rows, names, rounds=12, least=10, seed=1)
    again = pairwise.cross_ranked(rows.repartition(7), names, rounds=12, least=10, seed=1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    ours, other = ndcg(found, rows), ndcg(learned.cross_ranked(rows.fillna(0), names), rows)
    assert ours > 0.85 and ours > other, (ours, other)


def test_saved_scores_change_nothing(spark, monkeypatch):
    rows, names = candidates(spark, queries=10), ["a", "b"]
    whole = pairwise.cross_ranked(rows, names, rounds=5, least=5).collect()
    monkeypatch.setattr(pairwise, "SAVED", 2)
    assert sorted(map(tuple, pairwise.cross_ranked(rows, names, rounds=5, least=5).collect())) == sorted(map(tuple, whole))


def test_one_grade_teaches_nothing(spark):
    rows = candidates(spark, queries=5).withColumn("grade", F.lit(1))
    found = pairwise.cross_ranked(rows, ["a", "b"], rounds=2, limit=3).collect()
    assert {(r["rank"], r["id"], r["score"]) for r in found} == {(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)}
