"""Near-duplicates by min-max hashing: links at a Jaccard similarity or more, confirmed on full shingle sets, then connected components.

Signatures: each permutation gives its minimum and its maximum over a document's shingles, two values for one hash evaluation; bands of `rows`
values are the candidates' keys. Defaults: 96 permutations, 192 values, 32 bands of 6; a pair at 0.8 is missed with probability 6e-5.

Whole groups without all pairs:
1. Documents of equal sets are one class, and only classes go on.
2. Each class in a shared band is compared with one representative, the one that most of its bands name. Representatives are the classes with
   the fullest bands, so the centre of a group of copies links most of it at once.
3. In bands whose classes lie in different components, the outsiders (all but the band's main component) are compared with all members of
   the main one, then with the other outsiders of the band. Both go by blocks: a row per class and block, not one per pair. So every pair
   that shares a band is compared, or already lies in one component: no link that the bands propose is lost.
Confirmation counts shared shingles of the full sets (64-bit hashes of the words). Hot representatives, components and query lists are cut into
blocks of bounded size, so that no task holds a whole group. Of a block's links only those are written that join what the block has not joined
yet: at most one a class, however many pairs are alike.

Words: A-Z lower-cased, split at ASCII white space. Fewer words than a shingle: the whole sequence is one shingle. Null or blank text: the
empty set, linked with nothing. Null doc_id: such a document takes part, and its component's id is the smallest id that isn't null, or null.
Rows are told apart by a number of their own, never by doc_id, so rows that share an id or have none are linked by their texts alone. Of each
component one row stays, that of the smallest doc_id (null last, then the smallest number); a row linked with nothing always stays. `kept` tells
the rows with the component's id; a row without an id is kept where it is the one that stays. Repeated rows stay rows of their own, in one class.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, by_batches, numbered, read, staged

PERMUTATIONS, ROWS, BLOCK = 96, 6, 512
#: Words whose hashes a Python worker keeps; workers outlive their tasks.
WORDS_KEPT = 100_000
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def _word(w: bytes) -> int:
    found = _words.get(w)
    if found is None:
        found = _words[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
    return found


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    hashes = np.fromiter(map(_word, found), np.uint64, len(found))
    width = min(size, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * P1 + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(out)


@cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(1)
    return draw.integers(0, 1 << 32, count, np.uint32), draw.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def min_max(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    flip, factor = _permutations(permutations)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(permutations, np.uint32)
    for at in range(0, len(x), 4096):
        y = (x[at : at + 4096, None] ^ flip) * factor
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low, high = np.minimum(low, y.min(axis=0)), np.maximum(high, y.max(axis=0))
    return np.stack([low, high], axis=1).ravel()


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    # a band takes values of different permutations: the minima and maxima of one are not independent
    values = signature.astype(np.uint64).reshape(-1, 2).T.reshape(-1, rows)
    key = np.arange(len(values), dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * P1 + values[:, i])
    return key.view(np.int64)


def class_of(hashes: np.ndarray) -> bytes | None:
    return blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _signed(docs: DataFrame, size: int, permutations: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            known: dict[bytes, np.ndarray] = {}
            keys = []
            for s in sets:
                c = class_of(s)
                if c is not None and c not in known:
                    known[c] = band_keys(min_max(s, permutations), rows)
                keys.append((c, known.get(c)))
            yield pd.DataFrame({"file": batch["file"], "place": batch["place"], "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "class": [c for c, _ in keys], "bands": [k for _, k in keys]})
        _words.clear()  # workers outlive their tasks

    found = by_batches(docs.select("uid.file", "uid.place", "doc_id", "text"), sign, "file long, place long, doc_id long, n_shingles long, class binary, bands array<long>")
    return found.select(F.struct("file", "place").alias("uid"), "doc_id", "n_shingles", "class", "bands")


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and set of the wanted classes (class, uid: one of its documents)."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({"class": [class_of(s) for s in sets], "want": batch["class"], "set": [s.tobytes() for s in sets]})

    some = docs.select("uid", "text").join(classes, "uid")
    return by_batches(some.select("text", "class"), again, "class binary, want binary, set binary").where(F.col("class") == F.col("want")).groupBy("class").agg(F.first("set").alias("set"))


def linked(block: list[tuple[bytes, np.ndarray]], queries: Iterator[tuple[bytes, np.ndarray]], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """(query, member) for each query and each member that it reaches 100 * intersection >= percent * union with."""
    values = np.concatenate([s for _, s in block])
    owner = np.repeat(np.arange(len(block)), [len(s) for _, s in block])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for _, s in block])
    for name, s in queries:
        left, right = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        runs = right - left
        at = np.repeat(right - np.cumsum(runs), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], minlength=len(block))
        for i in np.flatnonzero(100 * shared >= percent * (sizes + len(s) - shared)):
            yield name, block[i][0]


def joining(links: Iterator[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The links that join what the ones before have not joined: the same components from at most one link a node."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (over := up.setdefault(x, x)) != x:
            up[x] = x = up[over]
        return x

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def _confirmed(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the queries and members of one group as all their links would; both: group string, class."""
    rows = members.select("group", F.lit(0).alias("role"), "class").unionByName(queries.select("group", F.lit(1).alias("role"), "class"))
    rows = rows.join(sets, "class").repartition("group").sortWithinPartitions("group", "role")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, block, asked = None, [], []

        def flush() -> list[tuple[bytes, bytes]]:
            return joining(linked(block, asked, percent)) if block and asked else []

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for g, role, c, s in zip(batch["group"], batch["role"], batch["class"], batch["set"], strict=True):
                if g != group or len(asked) >= BLOCK:
                    out += flush()
                    asked = []
                    if g != group:
                        group, block = g, []
                (asked if role else block).append((c, np.frombuffer(s, np.uint64)))
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(flush(), columns=["a", "b"])

    return by_batches(rows.select("group", "role", "class", "set"), stream, "a binary, b binary")


def components(edges: DataFrame, stage=staged) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the edges (a, b): smallest labels and pointer jumping."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        pulled = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = stage(pulled.join(jump, "to").select("node", "old", F.least("to", "far").alias("root")))
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, class, component_id and kept, one row per row of docs (doc_id, text)."""
    with Scratch(docs.sparkSession) as stage:
        return staged(grouped(numbered(docs).select("uid", "row.doc_id", "row.text"), stage, **options).drop("uid", "stays"))


def grouped(docs: DataFrame, stage: Scratch, size: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """uid, doc_id, n_shingles, class, component_id, stays and kept, one row per row of docs (uid: a struct that tells rows apart, doc_id, text).

    To be read before the block of `stage` ends."""
    signed = stage(_signed(docs, size, permutations, rows))
    plain = signed.select("uid", "doc_id", "n_shingles", "class")
    full = signed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("head"))
    # one row of bands per class
    bands = stage(signed.where(F.col("class").isNotNull()).select("class", F.explode("bands").alias("key")).distinct())
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stage(bands.join(shared, "key"))
    centre = shared.groupBy("class").agg(F.sum("n").alias("fullness"))
    lead = shared.join(centre, "class").groupBy("key").agg(F.max(F.struct("fullness", "class"))["class"].alias("lead"))
    votes = shared.join(lead, "key").groupBy("class", "lead").agg(F.count("*").alias("votes"))
    star = stage(votes.where(F.col("class") != F.col("lead")).groupBy("class").agg(F.max(F.struct("votes", "lead"))["lead"].alias("lead")))
    wanted = shared.select("class").distinct().join(full, "class").select("class", "head.uid")
    sets = stage(_sets(docs, wanted, size))
    # a representative's classes, in chunks of bounded size
    often = star.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("chunks"))
    chunked = star.join(often, "lead").withColumn("group", F.concat_ws("/", F.hex("lead"), F.pmod(F.xxhash64("class"), F.col("chunks"))))
    first = stage(_confirmed(chunked.select("group", F.col("lead").alias("class")).distinct(), chunked.select("group", "class"), sets, percent))
    root = components(first, stage)
    outsiders = stage(_outsiders(shared, root))
    rest = _against_main(shared, root, outsiders, stage)
    links = stage(first.unionByName(_confirmed(rest.where("role = 0"), rest.where("role = 1"), sets, percent)))
    root = components(links, stage)
    rest = _among(outsiders, root, stage)
    last = _confirmed(rest.where("role = 0"), rest.where("role = 1"), sets, percent).where(F.col("a") != F.col("b"))
    root = components(links.unionByName(last), stage)
    least = stage(full.join(root, full["class"] == root["node"], "left").select("class", "head", F.coalesce("root", "class").alias("root")))
    smallest = stage(least.groupBy("root").agg(F.min("head").alias("head")))
    of_class = least.select("class", "root").join(smallest, "root").select("class", F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("first"))
    out = plain.join(of_class, "class", "left").withColumn("component_id", F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))))
    out = out.withColumn("stays", F.col("class").isNull() | (F.col("uid") == F.col("first"))).drop("first")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), "stays"))


def _blocked(members: DataFrame, queries: DataFrame, stage: Scratch) -> DataFrame:
    """Rows (group, role, class) that bring every query (what, class) to every member (what, class) of its `what`, in blocks of both."""
    count = lambda rows, name: rows.groupBy("what").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    parts = stage(count(members, "blocks").join(count(queries, "chunks"), "what"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    group = F.concat_ws("/", "what", "block", "chunk").alias("group")
    left = members.join(parts, "what").withColumn("block", part("blocks")).withColumn("chunk", every("chunks")).select(group, F.lit(0).alias("role"), "class")
    right = queries.join(parts, "what").withColumn("chunk", part("chunks")).withColumn("block", every("blocks")).select(group, F.lit(1).alias("role"), "class")
    return stage(left.unionByName(right))


def _outsiders(shared: DataFrame, root: DataFrame) -> DataFrame:
    """key, class and the band's main component, for the bands with several components: the rows that are not in the main one."""
    placed = shared.select("key", "class").join(root, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    per_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = per_root.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).where(F.col("roots") > 1)
    return placed.join(main.select("key", "main"), "key").where(F.col("root") != F.col("main")).select("key", "class", "main")


def _against_main(shared: DataFrame, root: DataFrame, outsiders: DataFrame, stage: Scratch) -> DataFrame:
    """Groups of outsiders with the members of the main components of their bands."""
    queries = stage(outsiders.select(F.hex("main").alias("what"), "class").distinct())
    whole = shared.select("class").distinct().join(root, F.col("class") == F.col("node"), "left").select(F.hex(F.coalesce("root", "class")).alias("what"), "class")
    return _blocked(whole.join(queries.select("what").distinct(), "what", "left_semi"), queries, stage)


def _among(outsiders: DataFrame, root: DataFrame, stage: Scratch) -> DataFrame:
    """Groups of outsiders of one band that are still in different components."""
    placed = outsiders.join(root, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    mixed = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    rows = stage(placed.join(mixed, "key").select(F.col("key").cast("string").alias("what"), "class"))
    return _blocked(rows, rows, stage)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without near-copies: of each component one row stays, the one of the smallest doc_id (null last; of several rows of that id, one)."""
    rows = numbered(docs)
    with Scratch(docs.sparkSession) as stage:
        gone = staged(grouped(rows.select("uid", "row.doc_id", "row.text"), stage, **options).where(~F.col("stays")).select("uid"))
    return rows.join(gone, "uid", "left_anti").select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept")
