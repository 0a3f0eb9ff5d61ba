"""Packing documents into sequences of a fixed length by bulk-synchronous best fit.

Tokens: ids by a public vocabulary, then the end id. The vocabulary works word by word, so ids are kept by word and only new words are
encoded. Longer documents are cut into whole sequences and a last piece; no other is cut. A text that holds a special token's content goes to the
vocabulary's tokenizer whole, which gives it that token's id. Pieces carry their ids; packing goes by sizes alone and meets them again at the end.

Rounds, until no piece is left, each the same:
1. Open gaps: with none open, as many empty sequences as the rest needs at least.
2. Range-sort pieces and gaps together by size, and sweep each range: a gap takes its successor, the largest piece below it that no smaller gap
   has taken (a stack), then the largest that its rest holds, and so on within the range.
3. What a range can't match itself is a run of gaps and a run of pieces. A run of gaps meets the nearest runs of pieces below it, by counts alone,
   a few numbers per range: every gap gets as many pieces as surely fit, the smallest gap of the run divided by the largest piece. Where gaps
   compete for the same pieces, rank decides: the n-th gap takes the n-th lot of pieces from the large end.
4. Gaps shrink by what they got. A gap that got none fits nothing that is left, and closes.
So a gap that is wide beside the pieces left is filled by many at once, and the number of rounds doesn't follow the number of pieces in a
sequence (about a dozen rounds, where one piece a round takes dozens). A range's stack holds the range's pieces; there are as many ranges as
the shuffle has partitions, fewer once little is left.

Null text is empty: one token, the end id. Repeated rows are pieces of their own. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from siltstone.llm.shared import Scratch, by_batches, partitions, read, staged

CAPACITY, END, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces and gaps in a range at least, which a task holds with ease; rounds over fewer need one range, and so no exchange.
RANGE = 50_000
WORDS_KEPT, TOGETHER = 600_000, 1000
#: The vocabulary's own splitting rule, a fixed value of its file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Controls that not every engine calls white space, and characters whose lower case or composition isn't plain.
UNPLAIN = re.compile("[\x1c-\x1f\x85\u0130\u0250-\U0010ffff]")


@cache
def _tokenizers(name: str) -> tuple[Tokenizer, Tokenizer, np.ndarray, re.Pattern]:
    """The vocabulary's tokenizer, the same for words already split and normalised, which ids end a word, and its special tokens."""
    whole, split = (Tokenizer.from_file(public_tokenizers.path(name)) for _ in range(2))
    split.encode_special_tokens = True
    split.normalizer = normalizers.Sequence([])
    split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return whole, split, ends, re.compile("|".join(map(re.escape, special)) or r"(?!)")


class Encoder:
    """Little-endian unsigned 32-bit ids of texts. Words met before come from a bounded cache, the others are encoded together."""

    def __init__(self, name: str = VOCABULARY, kept: int = WORDS_KEPT):
        self.whole, self.split, self.ends, self.special = _tokenizers(name)
        self.kept, self.known = kept, {}

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.split.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a word that the vocabulary ends otherwise
                self.known.update((w, np.array(self.split.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
                continue
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, (4 * stops).tolist(), strict=True):
                self.known[w] = raw[start:stop]
                start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        found = [None if UNPLAIN.search(t) or self.special.search(t) else unicodedata.normalize("NFC", t).lower().split() for t in texts]
        new = set(chain.from_iterable(filter(None, found))).difference(known)
        missing = {c for c in new if c.isalpha()}  # a word as it stands
        parts = {c: SPLIT.findall(c) for c in new - missing}
        missing.update(w for words in parts.values() for w in words if w not in known)
        self._learn(list(missing))
        for c, words in parts.items():
            known[c] = b"".join([known[w] for w in words])
        get = known.__getitem__
        out = [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if f is None else b"".join(map(get, f)) for t, f in zip(texts, found, strict=True)]
        if len(known) > self.kept:  # full: what comes first, the frequent words, stays
            for w in missing.union(parts):
                known.pop(w, None)
        return out


@cache
def _encoder(name: str, kept: int) -> Encoder:
    """One for a Python worker, so that its tasks share the words."""
    return Encoder(name, kept)


def encodings(texts: pd.Series, encoder: Encoder) -> Iterator[bytes]:
    for at in range(0, len(texts), TOGETHER):
        yield from encoder.encode([t or "" for t in texts.iloc[at : at + TOGETHER]])


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of the whole texts of docs (doc_id, text). kept: words whose ids a Python worker keeps."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, kept)
        for batch in batches:
            rows = []
            for doc_id, encoded in zip(batch["doc_id"], encodings(batch["text"], encoder), strict=True):
                ids = encoded + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
            yield frame.astype({"doc_id": "Int64"})

    return by_batches(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids binary")


def _swept(pool: DataFrame, ranges: int) -> DataFrame:
    """Matches inside each of so many ranges of sizes. kind: 0 piece and 1 gap without a match, with their place in the range's run; 2 a match (gap `id` of
    `size`, piece `with` of length `place`); 3 what is left of a gap; 4 the range itself: gaps without a match (`id`) and the smallest of them (`size`), pieces without a match (`place`) and the
    largest of them (`with`)."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[int, int]] = []  # (size, id), rising
        part, gaps, least = -1, 0, 0
        for batch in batches:
            out = []
            for part, kind, size, ident in zip(batch["part"], batch["kind"], batch["size"], batch["id"], strict=True):
                if not kind:
                    stack.append((size, ident))
                    continue
                left, at = size, len(stack) - 1
                while at >= 0:
                    length, piece = stack.pop(at)
                    out.append((part, 2, left, ident, length, piece))
                    left -= length
                    at = bisect_right(stack, (left, math.inf)) - 1 if left else -1
                if left == size:
                    out.append((part, 1, size, ident, gaps, 0))
                    least = least if gaps else size
                    gaps += 1
                elif left:
                    out.append((part, 3, left, ident, 0, 0))
            yield pd.DataFrame(out, columns=["part", "kind", "size", "id", "place", "with"])
        if part >= 0:
            rest = [(part, 0, size, ident, i, 0) for i, (size, ident) in enumerate(stack)]
            yield pd.DataFrame([*rest, (part, 4, least, gaps, len(stack), stack[-1][0] if stack else 0)], columns=["part", "kind", "size", "id", "place", "with"])

    dealt = pool.coalesce(1) if ranges == 1 else pool.repartitionByRange(ranges, "size", "kind", "id")
    dealt = dealt.sortWithinPartitions("size", "kind", "id").withColumn("part", F.spark_partition_id())
    return dealt.select("part", "kind", "size", "id").mapInPandas(sweep, "part int, kind int, size long, id long, place long, with long")


@dataclass
class Run:
    """Pieces [first, end) of one range for the gaps from `gap` of another, `lot` pieces a gap; the last piece goes to the first gap."""

    owner: int
    first: int
    end: int
    part: int
    gap: int
    lot: int

    @property
    def gaps(self) -> int:
        return -(-(self.end - self.first) // self.lot)


def _runs(counts: list[tuple[int, int, int, int, int]]) -> list[Run]:
    """Runs from (range, gaps, smallest gap, pieces, largest piece), in order."""
    stack: list[tuple[int, int, int]] = []  # (range, pieces left, largest)
    found = []
    for part, gaps, least, pieces, most in counts:
        at = 0
        while at < gaps and stack:
            owner, left, largest = stack.pop()
            lot = max(1, least // largest)
            run = Run(owner, max(0, left - lot * (gaps - at)), left, part, at, lot)
            found.append(run)
            at += run.gaps
            if run.first:
                stack.append((owner, run.first, largest))
        if pieces:
            stack.append((part, pieces, most))
    return found


def _met(rest: DataFrame, runs: list[Run], ranges: int) -> DataFrame:
    """gap id, size, piece id `with`, its length, what the gap holds `before` it and whether it is the gap's `last`, for the pieces and gaps of matched runs. There are at most two runs a range."""
    spark = rest.sparkSession
    sides = [(r.owner, 0, r.first, r.end, r.lot, i) for i, r in enumerate(runs)] + [(r.part, 1, r.gap, r.gap + r.gaps, 1, i) for i, r in enumerate(runs)]
    table = F.broadcast(spark.createDataFrame(sides, "part int, kind int, first long, end long, lot long, run int"))
    inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))
    rank = F.when(F.col("kind") == 0, F.floor((F.col("end") - 1 - F.col("place")) / F.col("lot"))).otherwise(F.col("place") - F.col("first"))
    rows = rest.join(table, ["part", "kind"]).where(inside).select("run", rank.alias("rank"), "kind", "size", "id").repartition(ranges, "run", "rank")
    # a lot and its gap: the gap's row comes first, then its pieces, the largest first
    lot = Window.partitionBy("run", "rank").orderBy(F.desc("kind"), F.desc("size"), "id")
    before = F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("size"))).over(lot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.first(F.struct("id", "size")).over(lot)
    return rows.select("kind", gap.alias("gap"), F.col("id").alias("with"), F.col("size").alias("length"), before.alias("before"), F.lead("id").over(lot).isNull().alias("last")).where("kind = 0").select("gap.id", "gap.size", "with", "length", "before", "last")


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to parts (length, at most capacity, and any others; of those names they give way)."""
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    parts = staged(parts.select(F.struct(*columns).alias("row"), F.col("length").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")))
    with Scratch(parts.sparkSession) as stage:
        found = staged(_placed(parts.select("size", "id"), capacity, stage))
    return parts.join(found, "id").select("row.*", "sequence_id", "offset")


PLACED = "sequence_id long, id long, offset long"


def _placed(sizes: DataFrame, capacity: int, stage: Scratch) -> DataFrame:
    """sequence_id and offset of each id. What a round places is appended to one table; the tables it worked on go when the next round has read them."""
    spark = sizes.sparkSession
    add = lambda rows: stage.append(rows.select("sequence_id", "id", F.col("offset").cast("long").alias("offset")), "placed")
    pool = sizes.where(F.col("size") < capacity).select(F.lit(0).alias("kind"), "size", "id")
    add(sizes.where(F.col("size") == capacity).select((-1 - F.col("id")).alias("sequence_id"), "id", F.lit(0).alias("offset")))
    opened, pieces, open_gaps, before = 0, pool.count(), 0, None
    while pieces:
        if not open_gaps:
            fresh = math.ceil(pool.where("kind = 0").agg(F.sum("size")).first()[0] / capacity)
            pool = pool.unionByName(spark.range(opened, opened + fresh, 1, partitions(spark)).select(F.lit(1).alias("kind"), F.lit(capacity).cast("long").alias("size"), "id"))
            opened += fresh
            open_gaps = fresh
        round_ = Scratch(spark)
        ranges = max(1, min(partitions(spark), (pieces + open_gaps) // RANGE))
        swept = round_(_swept(pool, ranges))
        if before:
            before.__exit__()
        before = round_
        pairs = swept.where("kind = 2").select(F.col("id").alias("sequence_id"), F.col("with").alias("id"), (F.lit(capacity) - F.col("size")).alias("offset"))
        gaps = swept.where("kind = 3").select(F.lit(1).alias("kind"), "size", "id")
        pieces_left = swept.where("kind = 0")
        counts = swept.where("kind = 4").select("part", F.col("id").alias("g"), F.col("size").alias("least"), F.col("place").alias("p"), F.col("with").alias("most")).collect()
        runs = _runs(sorted(tuple(r) for r in counts))
        pieces = sum(r["p"] for r in counts) - sum(r.end - r.first for r in runs)
        if runs:
            met = round_(_met(swept.where("kind < 2"), runs, ranges))
            pairs = pairs.unionByName(met.select(F.col("id").alias("sequence_id"), F.col("with").alias("id"), (F.lit(capacity) - F.col("size") + F.col("before")).alias("offset")))
            left = F.col("size") - F.col("before") - F.col("length")
            gaps = gaps.unionByName(met.where("last").select(F.lit(1).alias("kind"), left.alias("size"), "id").where("size > 0"))
            taken: dict[int, int] = {}
            for r in runs:
                taken[r.owner] = min(r.first, taken.get(r.owner, r.first))
            limit = F.broadcast(spark.createDataFrame(list(taken.items()), "part int, limit long"))
            pieces_left = pieces_left.join(limit, "part", "left").where(F.col("limit").isNull() | (F.col("place") < F.col("limit")))
        add(pairs.coalesce(ranges))
        open_gaps = 0 if not pieces else gaps.count()
        pool = pieces_left.select(F.lit(0).alias("kind"), "size", "id").unionByName(gaps)
    if before:
        before.__exit__()
    return stage.table("placed", PLACED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests come from the pieces' ids; packing itself goes by lengths, so the ids need not travel with it."""
    digests = pieces(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(digests)
