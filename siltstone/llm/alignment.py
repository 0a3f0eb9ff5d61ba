"""Cross-tokenizer alignment: which tokens of two vocabularies end together, how often over the corpus, and how usual each document's links are.

A text is read as a space and the text, by a byte-level vocabulary (A) and by a piece vocabulary (B) that adds the space itself. Byte offsets
where a token of both ends cut the text into groups; the two tokens that end there are a link. Special tokens' strings are plain text.

Units. No token of either vocabulary spans from a character that isn't white space to the space or line feed after it, so a text is cut there
and each unit aligned once: its ids, groups and links come from a bounded cache of a Python worker, and new units are encoded together. What
the tokens' joined bytes give back is compared with the bytes read; a text with a unit that differs has no tokens.

Inverted pair bitmaps. Documents get slots in containers of at most 65,536 slots and ENTRIES entries. A pair of ids has in each container the
bitmap of the documents that hold it (plane 0) and bitmaps of the binary digits of how often beyond once (planes 1, 2, ...), each compressed to
sorted 16-bit slots where that is shorter. A container's batches are ORed before it goes out; different containers hold different documents, so the OR
over all of them is their union: a pair's document count is the sum of the popcounts of plane 0, its link count that plus
2^(k-1) times the popcounts of plane k. The postings then meet their pair's count and are dealt by container, where they add it to the slots
of a dense array: scores return to the documents without a row for every document and pair.

Scale. One pass over the texts, whose results are written; then two shuffles of postings, by pair and by container. A frequent pair has one row
a container and plane, of at most 8 KB. A task holds one container at a time. Pairs of one id of B are at most as many as A has ids.

Null or empty text, or bytes that differ: no tokens, zeros and groups ''. Repeated rows and rows without doc_id are documents of their own. Ties
for a B id's highest count all count as best. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.shared import BATCH_ROWS, Scratch, partitions, read, staged

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The byte-level vocabularies that are also there as ranks, whose encoder is faster.
RANKS = {BYTES: "byte_bpe_50k.tiktoken"}
SLOTS, ENTRIES = 1 << 16, 2_000_000
#: Units that a Python worker keeps, and that are encoded in one call.
UNITS_KEPT, TOGETHER = 600_000, 2000
_TWO, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?=[ \n])")
#: Beyond these characters, libraries may differ in what they call a letter.
_BEYOND = re.compile("[^\x00-\u024f]")


def _byte_level() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin ones themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fixed(ids: int, ends: str) -> np.ndarray:
    """Each id in decimal with each of the two ends, as rows of bytes padded with zeros."""
    return np.array([f"{i}{e}".encode() for i in range(ids) for e in ends])


class Vocabularies:
    """Ids and their bytes by both vocabularies."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Tokenizer.from_file(public_tokenizers.path(a)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        self.a.encode_special_tokens = True
        self.ranks = None
        if a in RANKS:
            lines = (line.split() for line in open(public_tokenizers.path(RANKS[a]), "rb"))
            self.ranks = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(w): int(i) for w, i in lines}, special_tokens={})
        level, names = _byte_level(), {i: w for w, i in self.a.get_vocab().items()}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special.get(i) or bytes(level[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # A's ids end in `,` or, the last of a group, `|`; B's in `,` or `;`
        self.printed = np.concatenate([_fixed(len(self.a_bytes), ",|"), _fixed(len(self.b_bytes), ",;")])
        self.printed_length = np.char.str_len(self.printed)

    def a_ids(self, text: str) -> list[int]:
        if self.ranks and not _BEYOND.search(text):
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace("▁", " ").encode()


@cache
def _vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


class Aligner:
    """Aligns texts unit by unit. kept: units that stay known."""

    def __init__(self, a: str = BYTES, b: str = PIECES, kept: int = UNITS_KEPT):
        self.of, self.kept = _vocabularies(a, b), kept
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[bytes] = []
        #: Tokens of A and B, groups, and 1 where the bytes differ.
        self.counts = np.zeros((2 * TOGETHER, 4), np.int64)

    @staticmethod
    def units(text: str) -> list[str]:
        """A unit without white space before it follows a space; the others begin with the white space they have."""
        if _TWO.search(text) or text[0].isspace() or text[-1].isspace():
            return _CUT.split(" " + text)
        return text.replace("\n", " \n").split(" ")

    def _store(self, units: list[str], groups: list[bytes], links: list[bytes], counts: np.ndarray) -> None:
        at = len(self.groups)
        self.known.update(zip(units, range(at, at + len(units)), strict=True))
        self.groups += groups
        self.links += links
        if at + len(units) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((len(self.counts) + len(units), 4), np.int64)])
        self.counts[at : at + len(units)] = counts

    def _learn(self, units: list[str]) -> None:
        of, whole = self.of, ["x", *[u if u[:1] in (" ", "\n") else " " + u for u in units]]
        text = "".join(whole)
        a, b = np.array(of.a_ids(" " + text), np.int64), np.array(of.b.encode(text), np.int64)
        stops = np.cumsum([len(u.encode()) for u in whole]) + 1
        a_ends, b_ends = np.cumsum(of.a_length[a]), np.cumsum(of.b_length[b])
        raw = (" " + text).encode()
        same = b"".join(map(of.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(of.b_bytes.__getitem__, b.tolist()))
        common = b_ends[a_ends[np.searchsorted(a_ends, b_ends)] == b_ends] if same else stops[:0]
        if not same or (common[np.searchsorted(common, stops)] != stops).any():
            if len(units) == 1:
                self._store(units, [b""], [b""], np.array([[0, 0, 0, 1]]))
                return
            for half in (units[: len(units) // 2], units[len(units) // 2 :]):
                self._learn(half)
            return
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_last, b_last = common[a_group] == a_ends, common[b_group] == b_ends
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = 2 * a + a_last
        order[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * (len(of.a_bytes) + b) + b_last
        printed = of.printed[order].tobytes().translate(None, b"\0")
        chars = np.concatenate([[0], np.cumsum(of.printed_length[order])])
        links = (a[a_last] * len(of.b_bytes) + b[b_last]).tobytes()
        at = np.stack([np.searchsorted(x, stops, "right") for x in (a_ends, b_ends, common)], 1)
        text_at, link_at = chars[at[:, 0] + at[:, 1]].tolist(), (8 * at[:, 2]).tolist()
        counts = np.zeros((len(units), 4), np.int64)
        counts[:, :3] = np.diff(at, axis=0)
        self._store(units, [printed[s:e] for s, e in zip(text_at, text_at[1:], strict=False)], [links[s:e] for s, e in zip(link_at, link_at[1:], strict=False)], counts)

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """For each text its counts (tokens of A, of B, groups), its groups as printed, and its links as a * (size of B) + b."""
        known = self.known
        cut = [self.units(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(known))
        plain = [u for u in new if not u[:1].isspace() or u[0] == "\n" and len(u) > 1 and not u[1].isspace() and not u[-1].isspace()]
        for at in range(0, len(plain), TOGETHER):
            self._learn(plain[at : at + TOGETHER])
        for unit in set(new).difference(plain):
            self._learn([unit])
        for units in cut:
            at = list(map(known.__getitem__, units))
            n = np.add.reduce(self.counts[np.array(at, np.int64)])
            if n[3] or not at:
                yield np.zeros(3, np.int64), b"", np.zeros(0, np.int64)
            else:
                yield n[:3], b"".join(map(self.groups.__getitem__, at))[:-1], np.frombuffer(b"".join(map(self.links.__getitem__, at)), np.int64)
        if len(known) > self.kept:  # full: what comes first, the frequent units, stays
            for unit in new:
                known.pop(unit)
            del self.groups[len(known) :], self.links[len(known) :]


@cache
def _aligner(a: str, b: str, kept: int) -> Aligner:
    """One for a Python worker, so that its tasks share the units."""
    return Aligner(a, b, kept)


_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]
_PAIR = [("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("dense", pa.bool_()), ("bits", pa.binary())]
_INDEX = pa.schema([("container", pa.int64()), ("slot", pa.int32()), *_DOC, *_PAIR])
INDEX = "container long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, plane int, dense boolean, bits binary"


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in _INDEX], schema=_INDEX)


def _planes(codes: np.ndarray, slots: np.ndarray, plane: int, container: int, size_b: int) -> Iterator[pa.RecordBatch]:
    """One plane's bitmaps from its entries, sorted by pair and slot: sorted slots, or a bitmap where that is shorter."""
    pairs, starts = np.unique(codes, return_index=True)
    if not len(pairs):
        return
    ends = np.append(starts[1:], len(codes))
    width = int(slots.max()) // 8 + 1
    dense = 2 * (ends - starts) > width
    long = []
    for s, e in zip(starts[dense].tolist(), ends[dense].tolist(), strict=True):
        bits = np.zeros(8 * width, np.uint8)
        bits[slots[s:e]] = 1
        long.append(np.packbits(bits, bitorder="little").tobytes())
    keep = ~np.repeat(dense, ends - starts)
    offsets = np.concatenate([[0], np.cumsum(2 * (ends - starts)[~dense])]).astype(np.int32)
    short = pa.Array.from_buffers(pa.binary(), int((~dense).sum()), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(slots[keep].astype("<u2").tobytes())])
    for some, bits in ((~dense, short), (dense, pa.array(long, pa.binary()))):
        if n := len(bits):
            a, b = np.divmod(pairs[some], size_b)
            yield _batch(n, container=pa.array(np.full(n, container)), a=pa.array(a), b=pa.array(b), plane=pa.array(np.full(n, plane)), dense=pa.array(np.full(n, bool(some is dense))), bits=bits)


def _container(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: list[tuple], container: int, size_b: int) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a container's pairs, then its documents."""
    if entries:
        codes, slots, times = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.argsort(codes, kind="stable")  # slots rise as they were met
        codes, slots, times = codes[order], slots[order], times[order]
        yield from _planes(codes, slots, 0, container, size_b)
        plane, beyond = 1, times - 1
        while (some := beyond > 0).any():
            codes, slots, beyond = codes[some], slots[some], beyond[some]
            odd = beyond % 2 == 1
            yield from _planes(codes[odd], slots[odd], plane, container, size_b)
            plane, beyond = plane + 1, beyond // 2
    names = ["slot", *[n for n, _ in _DOC]]
    for at in range(0, len(rows), BATCH_ROWS):
        some = rows[at : at + BATCH_ROWS]
        yield _batch(len(some), container=pa.array([container] * len(some)), **{n: pa.array(x) for n, x in zip(names, zip(*some, strict=True), strict=True)})


def indexed(docs: DataFrame, a: str = BYTES, b: str = PIECES, digest: bool = True, entries_most: int = ENTRIES, kept: int = UNITS_KEPT) -> DataFrame:
    """The inverted index of docs (doc_id, text): rows of documents (slot isn't null) and of bitmaps (a isn't null), by container. To be staged before it is read twice.
    groups: as printed, or with `digest` the sha256 of that."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b, kept)
        size_b = len(aligner.of.b_bytes)
        entries, rows, held, container = [], [], 0, None
        for batch in batches:
            ids, texts, places = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, place, (n, groups, links) in zip(ids, places, aligner.align(texts), strict=True):
                container = place if container is None else container
                codes, times = np.unique(links, return_counts=True)
                entries.append((codes, np.full(len(codes), len(rows), np.int32), times))
                printed = (hashlib.sha256(groups).hexdigest() if digest else groups.decode()) if groups else ""
                rows.append((len(rows), doc_id, *n.tolist(), len(links), printed))
                held += len(codes)
                if len(rows) == SLOTS or held >= entries_most:
                    yield from _container(entries, rows, container, size_b)
                    entries, rows, held, container = [], [], 0, None
        if rows:
            yield from _container(entries, rows, container, size_b)

    # a container is named by its first row's number, which holds the partition's; a task writes a container's documents and bitmaps together
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")).mapInArrow(build, INDEX)


def _popcount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones = [int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ones, pa.int64())], ["a", "b", "plane", "ones"])


def _weight() -> F.Column:
    return F.expr("if(plane = 0, 1L, shiftleft(1L, plane - 1))")


def pairs(index: DataFrame) -> DataFrame:
    """a, b, documents, links and whether no pair of the same b has more links (`best`), of all pairs that are linked."""
    rows = index.where("a is not null")
    short = rows.where("not dense").select("a", "b", "plane", (F.length("bits") / 2).cast("long").alias("ones"))
    long = rows.where("dense").select("a", "b", "plane", "bits").mapInArrow(_popcount, "a int, b int, plane int, ones long")
    counts = short.unionByName(long).groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("ones"))).alias("documents"), F.sum(F.col("ones") * _weight()).alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A container's postings come first and are added up by slot; its documents follow and take their sums."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    held, sums = None, np.zeros((SLOTS, 2), np.int64)
    for batch in batches:
        container = batch.column("container").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(container)) + 1).tolist(), len(container)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if container[start] != held:
                held = container[start]
                sums[:] = 0
            part = batch.slice(start, end - start)
            posting = np.flatnonzero(part.column("slot").is_null().to_numpy(zero_copy_only=False))
            if n := len(posting):  # they come first
                bits = part.column("bits").slice(0, n)
                value = np.stack([part.column(c).slice(0, n).to_numpy() for c in ("best_weight", "count_weight")], 1)
                dense = part.column("dense").slice(0, n).to_numpy(zero_copy_only=False).astype(bool)
                some = bits.filter(pa.array(~dense))
                if len(some):
                    offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
                    slots = np.frombuffer(some.buffers()[2], "<u2")[offsets[0] // 2 : offsets[-1] // 2] if offsets[-1] > offsets[0] else np.zeros(0, np.uint16)
                    each = np.repeat(value[~dense], np.diff(offsets) // 2, axis=0)
                    for k in (0, 1):
                        np.add.at(sums[:, k], slots, each[:, k])
                for i in np.flatnonzero(dense).tolist():
                    on = np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), bitorder="little"))
                    sums[on] += value[i]
            docs = part.slice(n)
            if len(docs):
                own = sums[docs.column("slot").to_numpy()]
                found = {c: docs.column(c) for c in names if c not in ("n_best", "count_sum")} | {"n_best": pa.array(own[:, 0]), "count_sum": pa.array(own[:, 1])}
                yield pa.RecordBatch.from_arrays([found[c] for c in names], names)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def scored(index: DataFrame, counts: DataFrame) -> DataFrame:
    """Each document's own columns with n_best and count_sum from the counts of its links' pairs."""
    # merged: the counts take little room on disk for their number, which grows with the vocabulary's use
    values = counts.select("a", "b", F.col("best").cast("long").alias("best"), "links").hint("merge")
    postings = index.where("a is not null").select("container", "a", "b", "plane", "dense", "bits").join(values, ["a", "b"])
    none = lambda name: F.lit(None).cast(name)
    own = [n for n, _ in _DOC]
    postings = postings.select("container", none("int").alias("slot"), *[none(f.dataType).alias(f.name) for f in index.schema if f.name in own], "dense", "bits", (F.col("best") * _weight()).alias("best_weight"), (F.col("links") * _weight()).alias("count_weight"))
    documents = index.where("slot is not null").select("container", "slot", *own, "dense", "bits", none("long").alias("best_weight"), none("long").alias("count_weight"))
    dealt = postings.unionByName(documents).repartition(partitions(index.sparkSession), "container").sortWithinPartitions("container", F.col("slot").isNotNull())
    return dealt.mapInArrow(_returned, RESULT)


def aligned(docs: DataFrame, a: str = BYTES, b: str = PIECES, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document."""
    with Scratch(docs.sparkSession) as stage:
        index = stage(indexed(docs, a, b, digest))
        return staged(scored(index, stage(pairs(index))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")
