"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, trained by FTRL-proximal, then temperature.

Features: n-grams of 1 to 3 characters of the whole text, lower-cased, all but letters as a blank, hashed to 2^15 places; sublinear counts times
inverse document frequency, scaled to length 1. Document frequencies count every training document.

Training: FTRL-proximal with L1 and L2 penalties (the elastic net; L1 leaves the weights sparse). The weights are fitted on a bounded sample: at most
`per_language` documents of each language, by a seeded hash. In each round every shard of the sample runs FTRL from the common state, and
their steps are averaged, by place and in Spark. A tenth of the sample is not trained on; it gives the temperature that minimises its log loss.

Prediction reads nothing but the text. Text null or without a letter: `und`, score 0. Nothing to learn from: `und`, score 0, everywhere.
Null lang: not learned from, predicted like any other. Null doc_id: neither held out nor learned from. Repeated rows are predicted alike; ties go
to the first language in code point order. The model's size is languages x 2^15, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, by_batches, read, unit

BITS = 15
PLACES = 1 << BITS
PER_LANGUAGE, SHARDS, ROUNDS = 1000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's n-grams."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_is_letter()[codes], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)  # runs of blanks are one
    codes = codes[keep]
    key, places = np.zeros(len(codes), np.uint32), []
    for n in range(3):
        key = key[: len(codes) - n] * np.uint32(0x9E3779B1) + codes[n:] + np.uint32(n + 1)
        mixed = key ^ (key >> np.uint32(15))
        places.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(places), minlength=PLACES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = grams(text)
    x = (1 + np.log(counts)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and by place how many have it. One row per place reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total[grams(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": np.append(at, -1), "n": np.append(total[at], n)})

    rows = by_batches(texts.select("text"), count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(PLACES)
    n = 0
    for r in rows:
        if r["place"] < 0:
            n = r["n"]
        else:
            out[r["place"]] = r["n"]
    return n, out


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (places, values, label); z and n (label x place) change."""
    for at, x, label in rows:
        zs, ns = z[:, at], n[:, at]
        w = weights_of(zs, ns)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x[None, :]
        g2 = g * g
        z[:, at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / ALPHA * w
        n[:, at] = ns + g2


def _shard(z: np.ndarray, n: np.ndarray, seed: int):
    """One shard's pass from the common state, as a function of the shard's rows."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        own_z, own_n = z.copy(), n.copy()
        part = part.sort_values(["deal", "label"], kind="stable")
        order = np.random.default_rng(seed).permutation(len(part))
        ftrl([(np.asarray(part["at"].iloc[i]), np.asarray(part["x"].iloc[i]), int(part["label"].iloc[i])) for i in order], own_z, own_n)
        moved = np.flatnonzero((own_n != n).any(axis=0))
        return pd.DataFrame({"place": moved.astype(np.int32), "z": list((own_z - z)[:, moved].T.astype(np.float32)), "n": list((own_n - n)[:, moved].T.astype(np.float32))})

    return train


class Model:
    """languages in code point order, weights (languages x 2^15), idf, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.idf, self.temperature = languages, np.ascontiguousarray(weights.T), idf, temperature

    def logits(self, text: str) -> np.ndarray:
        at, x = weighted(text, self.idf)
        return x @ self.weights[at]

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 5) -> Model | None:
    """A model of docs (doc_id, text, lang), or None if there is nothing to learn from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    languages = sorted(per, key=lambda x: [ord(c) for c in x])
    total, df = document_frequencies(usable)
    idf = np.log((1 + total) / (1 + df)) + 1
    label = {x: i for i, x in enumerate(languages)}
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_language / per[x]))) for x in languages])
    point = unit(F.lit(seed), "doc_id")
    sample = usable.where(point < share).select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10 * SHARDS)).cast("int").alias("deal"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [weighted(t, idf) for t in batch["text"]]
            yield pd.DataFrame({"deal": batch["deal"], "label": batch["lang"].map(label), "at": [a for a, _ in rows], "x": [x for _, x in rows]})

    with Scratch(docs.sparkSession) as stage:
        rows = stage(by_batches(sample, featured, "deal int, label int, at array<int>, x array<double>"))
        trained = rows.where(F.col("deal") % 10 != 0).withColumn("shard", F.floor(F.col("deal") / 10).cast("int"))
        z, n = np.zeros((len(languages), PLACES)), np.zeros((len(languages), PLACES))
        for _ in range(ROUNDS):
            _averaged(trained.groupBy("shard").applyInPandas(_shard(z, n, seed), "place int, z array<float>, n array<float>"), z, n)
        model = Model(languages, weights_of(z, n), idf, 1.0)
        model.temperature = _temperature(rows.where(F.col("deal") % 10 == 0), model.weights)
    return model


def _averaged(steps: DataFrame, z: np.ndarray, n: np.ndarray) -> None:
    """Moves z and n by the mean of the shards' steps. Spark adds the steps of a place, so the driver gets each place of the model once a round."""
    added = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), len(z)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias(c)
    for r in steps.groupBy("place").agg(added("z"), added("n")).toLocalIterator():
        z[:, r["place"]] += np.array(r["z"]) / SHARDS
        n[:, r["place"]] += np.array(r["n"]) / SHARDS


def _temperature(rows: DataFrame, weights: np.ndarray) -> float:
    """The temperature of least log loss over rows, of a fixed grid; 1 without rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(grid)), 0
        for batch in batches:
            for at, x, label in zip(batch["at"], batch["x"], batch["label"], strict=True):
                z = np.asarray(x) @ weights[np.asarray(at)]
                scaled = z[None, :] / grid[:, None]
                top = scaled.max(axis=1)
                total += top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[:, label]
                n += 1
        yield pd.DataFrame({"i": np.arange(len(grid)), "loss": total, "n": n})

    found = rows.mapInPandas(losses, "i long, loss double, n long").groupBy("i").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).where("n > 0").orderBy("loss", "i").first()
    return float(grid[found["i"]]) if found else 1.0


def prediction(model: Model | None, text: Column) -> Column:
    """A struct of lang_pred and score."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series, some: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) if s else (UNKNOWN, 0.0) for t, s in zip(texts, some, strict=True)], columns=["lang_pred", "score"])

    return run(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score added; columns of those names give way."""
    found = docs.select(F.struct(*docs.columns).alias("row"), prediction(model, F.col("text")).alias("found"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "found.lang_pred", "found.score")


def known(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The documents of a known language: predicted with a score of `least` or more; without a model, those with a letter."""
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(F.struct(*docs.columns).alias("row"), prediction(model, F.col("text")).alias("found"))
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
