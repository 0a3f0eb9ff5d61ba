"""Toxicity: a linear-chain conditional random field tags the toxic words of a text; its marginals give the document's score and the spans.

Labelled tokens. Labels mark documents, so tokens are labelled from them: a form (a word, or a beginning of a word of PREFIXES letters) is toxic if the
documents that have it are labelled toxic beyond chance: a likelihood ratio against the labels' own rate, with Bonferroni's bound for all
forms tried. A copied passage counts once: of equal contexts (a word and both neighbours) only one document counts. In documents labelled
toxic the words with such a form are toxic tokens; every other token, and all tokens of clean documents, are not.

Field. Two states. A word's features are itself, its beginnings and ends and the two neighbours, hashed to WEIGHTS weights; transitions and the
start have weights of their own. Forward-backward runs over all texts of a batch as one chain: products of 2 x 2 matrices by segments, then
the segments' states, then the states inside (log n levels of array operations, exact). A document's first token resets the chain.

Training. A bounded sample: at most PER_LABEL documents of each label, by hash; whole texts. It is dealt into shards of some SHARD documents; in each of ROUNDS rounds a task fits
a shard by STEPS steps of Adam on the penalised likelihood from the common weights, and Spark averages what the shards give by weight. A tenth
of the sample only calibrates: a logistic regression of the label on the two greatest marginals and the expected number of toxic tokens,
weighted to the labels' rate.

Scoring reads every whole text once, in batches; a Python worker keeps the values of WORDS_KEPT words. Memory: a batch's tokens go in parts of
TOKENS, a single text at least.

Null, empty or wordless text: no token, scored as a text without toxic words. Without labelled documents of both kinds, or without a toxic form,
every score is the labels' rate (0 without labels). A document labelled twice is toxic if a label says so; null labels and ids don't count. Repeated rows
are documents of their own. Empty tables give no rows; columns of other names are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import BATCH_ROWS, Scratch, numbered, read

WEIGHTS, PREFIXES, SUFFIXES = 1 << 18, (4, 5, 6), (3, 4)
PER_LABEL, SHARD, ROUNDS, STEPS, RATE, PENALTY = 3000, 750, 2, 40, 0.3, 0.02
#: Words in a sample document from which it is a toxic one, and the share of a form's documents that are.
THRESHOLD, SHARE = 0.7, 0.5
WORDS_KEPT, TOKENS, SEGMENT = 300_000, 200_000, 64
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def forms(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]


@cache
def _place(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % WEIGHTS


def features(word: str) -> tuple[list[int], int, int]:
    """Places of a word's own weights, and of those it has as the word before and the word after."""
    names = ["", *forms(word), *[f"*{word[-n:]}" for n in SUFFIXES if len(word) > n]]
    at = [xxhash.xxh3_64_intdigest(f"w {n}") % WEIGHTS for n in names[1:]]
    return [_place("bias"), *at], xxhash.xxh3_64_intdigest(f"< {word}") % WEIGHTS, xxhash.xxh3_64_intdigest(f"> {word}") % WEIGHTS


def _chained(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x: float = 0.5) -> np.ndarray:
    """The first share of the row vector (x, 1 - x) after each of the 2 x 2 matrices [[a, b], [c, d]], which multiply it one after another."""
    n = len(a)
    if n <= SEGMENT:
        out = np.empty(n)
        for i, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
            first, second = x * p + (1 - x) * r, x * q + (1 - x) * s
            out[i] = x = first / (first + second)
        return out
    k = -(-n // SEGMENT)
    rows = []
    for m, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        full = np.full(k * SEGMENT, fill)
        full[:n] = m
        rows.append(np.ascontiguousarray(full.reshape(k, SEGMENT).T))
    p, q, r, s = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for t in range(SEGMENT):
        a_, b_, c_, d_ = (m[t] for m in rows)
        p, q, r, s = p * a_ + q * c_, p * b_ + q * d_, r * a_ + s * c_, r * b_ + s * d_
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    at = np.concatenate([[x], _chained(p, q, r, s, x)[:-1]])
    out = np.empty((SEGMENT, k))
    for t in range(SEGMENT):
        a_, b_, c_, d_ = (m[t] for m in rows)
        first, second = at * a_ + (1 - at) * c_, at * b_ + (1 - at) * d_
        out[t] = at = first / (first + second)
    return out.T.reshape(-1)[:n]


def marginals(values: np.ndarray, starts: np.ndarray, moves: np.ndarray, expected: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of the toxic state, and, if wanted, the expected moves (into toxic, out of it, staying, starting there).

    values: what the toxic state gains at each token; starts: whether it begins a text; moves: weights of those four."""
    n = len(values)
    if not n:
        return np.zeros(0), np.zeros(4)
    gain = np.exp(np.clip(values, -30, 30))
    into, out, stay, start = np.exp(np.clip(moves, -30, 30))
    # [[clean to clean, clean to toxic], [toxic to clean, toxic to toxic]]; at a start, both rows alike forget what was before
    a, b = np.ones(n), gain * np.where(starts, start, into)
    c, d = np.where(starts, 1.0, out), gain * np.where(starts, start, stay)
    clean = _chained(a, b, c, d)
    after = np.full(n, 0.5)
    if n > 1:
        after[:-1] = _chained(a[:0:-1], c[:0:-1], b[:0:-1], d[:0:-1])[::-1]
    toxic = (1 - clean) * (1 - after)
    toxic = toxic / (toxic + clean * after)
    if not expected:
        return toxic, np.zeros(4)
    went = np.zeros((4, n - 1))
    went[0], went[1], went[2] = clean[:-1] * b[1:] * (1 - after[1:]), (1 - clean[:-1]) * c[1:] * after[1:], (1 - clean[:-1]) * d[1:] * (1 - after[1:])
    went[3] = clean[:-1] * a[1:] * after[1:]
    went = (went / went.sum(0))[:, ~starts[1:]]
    return toxic, np.array([*went[:3].sum(1), toxic[starts].sum()])


class Words:
    """The numbers of words and, by number, what their features give. kept: words that stay known."""

    def __init__(self, weights: np.ndarray, kept: int = WORDS_KEPT):
        self.weights, self.kept = weights, kept
        self.known: dict[str, int] = {}
        self.values = np.zeros((1 << 12, 3))

    def numbers(self, texts: list[list[str]]) -> list[int]:
        known = self.known
        for word in set().union(*texts).difference(known):
            at = known[word] = len(known)
            if at >= len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            own, before, after = features(word.lower())
            self.values[at] = self.weights[own].sum(), self.weights[before], self.weights[after]
        return [known[w] for t in texts for w in t]

    def forget(self) -> None:
        """Called between batches: when full, what came first, the frequent words, stays."""
        while len(self.known) > self.kept:
            self.known.popitem()

    def scored(self, texts: list[list[str]], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' marginals, and where each text that has tokens begins."""
        at = np.array(self.numbers(texts), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = (np.cumsum(lengths) - lengths)[lengths > 0]
        starts = np.zeros(len(at), bool)
        starts[begins] = True
        of = self.values[at]
        value = of[:, 0].copy()
        value[1:] += np.where(starts[1:], 0.0, of[:-1, 1])
        value[:-1] += np.where(starts[1:], 0.0, of[1:, 2])
        return marginals(value, starts, moves, expected=False)[0], begins


@dataclass(frozen=True)
class Model:
    """weights by place; moves as in `marginals`; calibration: constant and three slopes; rate of the label among all labelled documents."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS, np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.5, 0.5, 0.0]))
    rate: float = 0.0
    learned: bool = False


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 4e-5, 1 - 4e-5)
    return np.log(p / (1 - p))


def evidence(texts: list[str | None], words_: Words, moves: np.ndarray) -> np.ndarray:
    """A row for each text: logits of its two greatest marginals, and the logarithm of the expected number of toxic tokens."""
    out = np.tile([float(_logit(np.zeros(1))[0])] * 2 + [math.log(1e-4)], (len(texts), 1))
    split = [words(t) for t in texts]
    part: list[int] = []
    held = 0
    for i in range(len(split) + 1):
        if part and (i == len(split) or held + len(split[i]) > TOKENS):
            toxic, begins = words_.scored([split[j] for j in part], moves)
            first = np.maximum.reduceat(toxic, begins)
            total = np.add.reduceat(toxic, begins)
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(toxic))))
            best = np.full(len(begins), -1)
            most = np.flatnonzero(toxic == first[group])[::-1]
            best[group[most]] = most  # of ties the first
            rest = toxic.copy()
            rest[best] = 0
            out[part] = np.stack([_logit(first), _logit(np.maximum.reduceat(rest, begins)), np.log(total + 1e-4)], 1)
            part, held = [], 0
        if i < len(split) and split[i]:
            part.append(i)
            held += len(split[i])
    return out


def likelihood(rows: np.ndarray, model: Model) -> np.ndarray:
    if not model.learned:
        return np.full(len(rows), model.rate)
    return 1 / (1 + np.exp(-(model.calibration[0] + rows @ model.calibration[1:])))


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, float]:
    """text, toxic, part (0 calibrates), number of the sampled labelled rows of docs, and the rate of the label. A row drawn by the hash of its id and text."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = numbered(docs)
    drawn = rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.doc_id", "row.text").alias("order")).join(marks, "doc_id").select("uid", (F.col("toxic") > 0).alias("toxic"), "order")
    totals = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    rate = totals.get(True, 0) / max(1, sum(totals.values()))
    some = [drawn.where(F.col("toxic") == t).orderBy("order", "uid").limit(per_label) for t in (True, False)]
    chosen = some[0].unionByName(some[1]).withColumn("part", F.pmod("order", F.lit(10)))
    return rows.select("uid", F.col("row.text").alias("text")).join(F.broadcast(chosen), "uid").select("text", "toxic", "part", F.xxhash64("uid").alias("number")), rate


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, toxic, number in zip(batch["text"], batch["toxic"], batch["number"], strict=True):
            own = [w.lower() for w in words(text)]
            around = zip(["", *own], own, [*own[1:], ""], strict=False)
            rows += [(w, xxhash.xxh3_64_intdigest(f"{x} {w} {y}") >> 1, toxic, number) for x, w, y in set(around)]
        yield pd.DataFrame(rows, columns=["word", "context", "toxic", "number"])


def _formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(f, toxic, number) for w, toxic, number in zip(batch["word"], batch["toxic"], batch["number"], strict=True) for f in forms(w)]
        yield pd.DataFrame(rows, columns=["form", "toxic", "number"])


def toxic_forms(sample: DataFrame) -> set[str]:
    """Forms that only toxic documents explain. The sample is bounded, so what comes back is."""
    found = sample.mapInPandas(_contexts, "word string, context long, toxic boolean, number long").groupBy("word", "context", "toxic").agg(F.min("number").alias("number"))
    apart = found.select("word", "toxic", "number").distinct().mapInPandas(_formed, "form string, toxic boolean, number long").distinct()
    counts = apart.groupBy("form").agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic"), 1)).alias("k"))
    documents = sample.groupBy("toxic").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()
    share = sum(r["n"] for r in documents if r["toxic"]) / max(1, sum(r["n"] for r in documents))
    if not 0 < share < 1:
        return set()
    tried = counts.where("n >= 3")
    bound = math.log(max(1, tried.count()))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ratio = k * F.log(k / (n * share)) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    rows = tried.where((F.col("k") > 0) & (k >= SHARE * n) & (k > n * share)).where(ratio >= bound).select("form").collect()
    return {r["form"] for r in rows}


class Shard:
    """Labelled tokens of one shard, and steps on their likelihood."""

    def __init__(self, texts: list[str | None], toxic: list[bool], known: set[str]):
        lower = [[w.lower() for w in words(t)] for t in texts]
        kept = [(t, y) for t, y in zip(lower, toxic, strict=True) if t]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t, _ in kept for w in t))}
        marked = np.array([not known.isdisjoint(forms(w)) for w in vocabulary], bool)
        self.at = np.array([vocabulary[w] for t, _ in kept for w in t], np.int64)
        lengths = np.array([len(t) for t, _ in kept], np.int64)
        self.starts = np.zeros(len(self.at), bool)
        self.starts[np.cumsum(lengths) - lengths] = True
        self.y = (marked[self.at] if len(marked) else np.zeros(0, bool)) & np.repeat(np.array([y for _, y in kept], bool), lengths)
        of = [features(w) for w in vocabulary]
        self.sizes = np.array([len(f[0]) for f in of], np.int64)
        places = np.concatenate([np.array([p for f in of for p in f[0]], np.int64), np.array([f[1] for f in of], np.int64), np.array([f[2] for f in of], np.int64)])
        self.used, self.index = np.unique(places, return_inverse=True)
        inner = ~self.starts[1:]
        y = self.y.astype(float)
        self.moved = np.array([((1 - y[:-1]) * y[1:])[inner].sum(), (y[:-1] * (1 - y[1:]))[inner].sum(), (y[:-1] * y[1:])[inner].sum(), y[self.starts].sum()])

    def fit(self, weights: np.ndarray, moves: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """The weights at `used` and the moves after so many steps."""
        n, v = len(self.used), len(self.sizes)
        x = np.concatenate([weights[self.used].astype(float), moves])
        first, second = np.zeros_like(x), np.zeros_like(x)
        own, owner = self.index[: self.sizes.sum()], np.repeat(np.arange(v), self.sizes)
        before, after = self.index[self.sizes.sum() :].reshape(2, v)
        inner = np.where(self.starts[1:], 0.0, 1.0)
        for step in range(1, steps + 1):
            value = np.bincount(owner, x[own], v)[self.at]
            value[1:] += inner * x[before][self.at[:-1]]
            value[:-1] += inner * x[after][self.at[1:]]
            toxic, moved = marginals(value, self.starts, x[n:])
            miss = self.y - toxic
            by_word = np.bincount(self.at, miss, v)
            slope = np.bincount(own, by_word[owner], n)
            slope += np.bincount(before, np.bincount(self.at[:-1], inner * miss[1:], v), n) + np.bincount(after, np.bincount(self.at[1:], inner * miss[:-1], v), n)
            slope = np.concatenate([slope, self.moved - moved]) - PENALTY * x
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            x = x + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return x[:n], x[n:]


def trained(sample: DataFrame, known: set[str]) -> Model:
    """The field's weights from the sample's shards (part, number, text, toxic)."""
    model = Model(learned=True)

    def stepped(weights: np.ndarray, moves: np.ndarray):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("number")
            shard = Shard(frame["text"].tolist(), frame["toxic"].tolist(), known)
            found, moved = shard.fit(weights, moves) if len(shard.at) else (weights[shard.used], moves)
            return pd.DataFrame({"at": np.append(shard.used, WEIGHTS + np.arange(4)), "value": np.append(found, moved)})

        return one

    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(-(-sample.count() // SHARD))))
    for _ in range(ROUNDS):
        fitted = dealt.groupBy("shard").applyInPandas(stepped(model.weights, model.moves), "at long, value double")
        rows = fitted.groupBy("at").agg(F.avg("value").alias("value")).toPandas().sort_values("at")  # at most a row a weight
        weights, moves = model.weights.copy(), model.moves.copy()
        at, value = rows["at"].to_numpy(np.int64), rows["value"].to_numpy(float)
        weights[at[at < WEIGHTS]] = value[at < WEIGHTS]
        moves[at[at >= WEIGHTS] - WEIGHTS] = value[at >= WEIGHTS]
        model = replace(model, weights=weights, moves=moves)
    return model


def calibrated(rows: np.ndarray, toxic: np.ndarray, rate: float, start: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the evidence by Newton's method, drawn to `start`; documents weigh by the labels' rate."""
    share = toxic.mean() if len(toxic) else 0.0
    if not 0 < share < 1:
        return start
    x, w = np.column_stack([np.ones(len(rows)), rows]), start.copy()
    weight = np.where(toxic, rate / share, (1 - rate) / (1 - share))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - (w - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(4)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    # evidence never counts against a text: slopes stay at 0 or above
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from all given labelled documents (doc_id, text; doc_id, toxic), of which it draws a bounded sample."""
    with Scratch(docs.sparkSession) as stage:
        some, rate = sampled(docs, labels, per_label)
        sample = stage(some)
        known = toxic_forms(sample.where("part > 0"))
        if not known:
            return Model(rate=rate)
        model = replace(trained(sample.where("part > 0"), known), rate=rate)
        apart = sample.where("part = 0").mapInPandas(_evidence(model), "toxic boolean, number long, a double, b double, c double").toPandas().sort_values("number")
        return replace(model, calibration=calibrated(apart[["a", "b", "c"]].to_numpy(float), apart["toxic"].to_numpy(bool), rate, model.calibration))


def _evidence(model: Model):
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(model.weights)
        for batch in batches:
            rows = evidence(batch["text"].tolist(), known, model.moves)
            yield pd.DataFrame({"toxic": batch["toxic"], "number": batch["number"], "a": rows[:, 0], "b": rows[:, 1], "c": rows[:, 2]})

    return one


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    @F.pandas_udf("double")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Words(model.weights)
        for texts in batches:
            yield pd.Series(likelihood(evidence(texts.tolist(), known, model.moves), model))
            known.forget()

    return docs.withColumn(name, one("text"))


def tagged(docs: DataFrame, model: Model, least: float = 0.5, name: str = "spans") -> DataFrame:
    """docs with the toxic spans of each whole text: start and end (code points, end exclusive) and probability of each run of tokens with a marginal of `least` or more."""

    @F.pandas_udf("array<struct<start: int, end: int, probability: double>>")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Words(model.weights)
        for texts in batches:
            out = []
            for text in texts:
                found = list(_WORD.finditer(text or ""))
                toxic = known.scored([[m[0] for m in found]], model.moves)[0] if found and model.learned else np.zeros(0)
                runs: list[dict] = []
                last = -2
                for i in np.flatnonzero(toxic >= least).tolist():
                    if i == last + 1:
                        runs[-1] |= {"end": found[i].end(), "probability": max(runs[-1]["probability"], float(toxic[i]))}
                    else:
                        runs.append({"start": found[i].start(), "end": found[i].end(), "probability": float(toxic[i])})
                    last = i
                out.append(runs)
            yield pd.Series(out, dtype=object)
            known.forget()

    return docs.withColumn(name, one("text"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out()), read(spark, sf_dir, "labels"))
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
