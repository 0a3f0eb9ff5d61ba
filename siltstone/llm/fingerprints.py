"""Document fingerprints by consistent weighted sampling of words, weighted by how often a document has them.

For each sample and word, r and c are gamma(2, 1) and b uniform, drawn from a hash of the word: t = floor(ln(weight) / r + b),
y = exp(r * (t - b)), a = c / (y * e^r). The sample is the word of the least a, with its t. Two documents agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of least weights / sum of greatest; the share of equal samples estimates it (64 samples:
a standard error of at most 0.0625).

A fingerprint is the samples' 16-bit hashes in hexadecimal. Words: lower-cased, split at white space. Null, empty or blank text: no word, and a
fingerprint of zeros, alike to itself and to no other. Equal texts have equal fingerprints. Repeated rows are documents of their own.

Neighbours: documents are dealt out by ranges of (doc_id, a hash of the text) and sorted there, the first of each range goes to the range before as
well, so a document meets the next with one shuffle and no global sort. There are as many ranges as the shuffle has partitions, cut at the
quantiles of a bounded sample; so what the driver and every task hold of them doesn't grow with the rows, and many rows of one doc_id are many
ranges. Null ids come first; ties of doc_id go by that hash, then by text. A lone document is its own next.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import by_batches, partitions, read

SAMPLES, WORDS_KEPT = 64, 100_000
EMPTY = "0000" * SAMPLES
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _drawn(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each word and sample, from two 64-bit hashes of three 21-bit numbers each."""
    at = np.arange(1, 2 * samples + 1, dtype=np.uint64) * _GOLDEN
    x = _mix(hashes[:, None] + at[None, :]).reshape(len(hashes), 2, samples)
    u = lambda i, shift: (((x[:, i] >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)
    return -np.log(u(0, 43) * u(0, 22)), np.log(-np.log(u(1, 43) * u(1, 22))), u(0, 1)


def _hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Sampler:
    """Consistent weighted samples of word counts. Keeps the draws of the words that come first, up to a bound."""

    def __init__(self, samples: int = SAMPLES, kept: int = WORDS_KEPT):
        self.samples, self.kept = samples, kept
        self.place: dict[str, int] = {}
        self.hashes = np.empty(kept, np.uint64)
        self.r, self.c, self.b, self.once = (np.empty((kept, samples), np.float32) for _ in range(4))

    def signature(self, text: str) -> np.ndarray:
        """The 16-bit samples of a text."""
        counts = Counter(text.lower().split())
        if not counts:
            return np.zeros(self.samples, np.uint16)
        place, words = self.place, list(counts)
        at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
        weights = np.fromiter(counts.values(), np.float32, len(words))
        new = np.flatnonzero(at < 0)
        hashes = self.hashes[at]
        least = self.once[at]
        drawn = None
        if len(new):
            fresh = np.fromiter((_hashed(words[i]) for i in new), np.uint64, len(new))
            r, c, b = drawn = _drawn(fresh, self.samples)
            once = c + r * b - r
            hashes[new], least[new] = fresh, once
            n = len(place)
            if n + len(new) <= self.kept:
                to = slice(n, n + len(new))
                self.hashes[to], self.r[to], self.c[to], self.b[to], self.once[to] = fresh, r, c, b, once
                place.update((words[i], n + k) for k, i in enumerate(new.tolist()))
        often = np.flatnonzero(weights > 1)
        row = np.zeros(len(words), np.int64)
        steps = np.zeros((1, self.samples), np.int64)
        if len(often):
            r, c, b = self.r[at[often]], self.c[at[often]], self.b[at[often]]
            if drawn is not None:
                where = np.full(len(words), -1)
                where[new] = np.arange(len(new))
                own = np.flatnonzero(where[often] >= 0)
                for to, of in zip((r, c, b), drawn, strict=True):
                    to[own] = of[where[often[own]]]
            t = np.floor(np.log(weights[often])[:, None] / r + b)
            least[often] = c - r * (t - b) - r
            row[often] = np.arange(1, len(often) + 1)
            steps = np.concatenate([steps, t.astype(np.int64)])
        best = least.argmin(axis=0)
        picked = _mix(hashes[best] + steps[row[best], np.arange(self.samples)].astype(np.uint64) * _GOLDEN)
        return np.maximum((picked >> np.uint64(48)).astype(np.uint16), np.uint16(1))


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column."""

    @F.pandas_udf("string")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler()
        for batch in batches:
            yield pd.Series([printed(sampler.signature(t or "")) for t in batch], dtype=object)

    return docs.withColumn(name, one(F.col(text)))


#: Keys of the sample that gives the cuts, for each range.
KEYS = 50


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (range, role, doc_id, text) dealt by range and sorted; role 1 is the first of the next range, after its own documents."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("doc_id").isNotNull().cast("int").alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    key = F.struct("some", "id", "h").alias("key")
    n = partitions(spark)
    drawn = F.pmod(F.xxhash64("id", "h", F.lit(29)), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, n * KEYS / max(1, docs.count()))))
    # repeated rows are one key, so the sample is bounded by distinct keys
    sample = sorted(tuple(r["key"]) for r in rows.where(drawn).select(key).distinct().collect())
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    names, places = [c[:2] for c in cuts], [c[2] for c in cuts]

    @F.pandas_udf("int")
    def range_of(some: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(s: int, i: int, h: int) -> int:
            first, last = bisect_left(names, (s, i)), bisect_right(names, (s, i))
            return bisect_right(places, h, first, last)

        return pd.Series([one(*r) for r in zip(some, ids, hashes, strict=True)], dtype="int32")

    placed = rows.withColumn("range", range_of("some", "id", "h"))
    starts = sorted((r["range"], *r["key"]) for r in placed.groupBy("range").agg(F.min(key).alias("key")).collect())
    if not starts:
        return placed.withColumn("role", F.lit(0)).select("range", "role", "doc_id", "text")
    heads = [(starts[i - 1][0], *first) for i, (_, *first) in enumerate(starts)]
    table = F.broadcast(spark.createDataFrame(heads, "range int, some int, id long, h long"))
    first = rows.join(table, ["some", "id", "h"]).groupBy("range", "some", "id", "h").agg(F.min("text").alias("text"))
    own = placed.select("range", F.lit(0).alias("role"), "doc_id", "some", "id", "h", "text")
    every = own.unionByName(first.select("range", F.lit(1).alias("role"), F.lit(None).cast("long").alias("doc_id"), "some", "id", "h", "text"))
    return every.repartition(n, "range").sortWithinPartitions("range", "role", "some", "id", "h", "text").select("range", "role", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        held = None
        for batch in batches:
            out = []
            for place, role, doc_id, text in zip(batch["range"], batch["role"], batch["doc_id"], batch["text"], strict=True):
                mark = sampler.signature(text)
                if held is not None and held[0] == place:
                    _, own, before, known = held
                    cut = len(before) // 4
                    edited = before[: len(before) - cut] + text[:cut]
                    changed = known if edited == before else sampler.signature(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    out.append((own, len(before), digest, printed(known), printed(changed), likeness(known, changed), likeness(known, mark)))
                held = None if role else (place, doc_id, text, mark)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return by_batches(beside_next(docs), walk, RESULT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read(spark, sf_dir, "documents"))
