"""Queries and stages, whole, against plain versions that share no code with them; values on odd rows."""

import hashlib
import math
import struct
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import fingerprints, language_id, near_dedup, packing, pii, sharding, source_mixing, topk_search, url_filters
from siltstone.llm.shared import numbered, shared_folder
from tests.llm.conftest import CLASH, SCHEMA, sentence
from tests.llm.test_brute import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plain"))
    odd.drop(*CLASH).write.parquet(f"{path}/documents.parquet")
    return path


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_samples(text, samples=64):
    """Consistent weighted sampling, a word and a sample at a time, in doubles."""
    counts, out = Counter(text.lower().split()), []
    for i in range(samples):
        best = None
        for word, n in counts.items():
            h = xxhash.xxh3_64_intdigest(word)
            parts = [plain_mix((h + (k + 1) * 0x9E3779B97F4A7C15) % 2**64) for k in (i, samples + i)]
            u = [[((p >> s & 0x1FFFFF) + 0.5) / 2**21 for s in (43, 22, 1)] for p in parts]
            r, c = -math.log(u[0][0] * u[0][1]), -math.log(u[1][0] * u[1][1])
            b = u[0][2]
            t = math.floor(math.log(n) / r + b)
            a = math.log(c) - r * (t - b) - r
            best = min(best, (a, h, t)) if best else (a, h, t)
        picked = plain_mix((best[1] + best[2] * 0x9E3779B97F4A7C15) % 2**64) if best else 0
        out.append(max(picked >> 48, 1) if best else 0)
    return out


def test_fingerprints_by_words_and_samples():
    sampler = fingerprints.Sampler()
    for text in (sentence(3, 50) + " the the the and and", "one", "", sentence(9, 80)):
        plain, ours = plain_samples(text), sampler.signature(text).tolist()
        assert sum(a == b for a, b in zip(plain, ours, strict=True)) >= 62  # float32 may turn a tie


def test_op8_whole_query(spark, folder, odd_rows):
    found = fingerprints.op8_fingerprints(spark, folder).collect()
    sampler = fingerprints.Sampler()
    print_of = lambda t: fingerprints.printed(sampler.signature(t))
    # nulls first, ties of an id by a hash of the text
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, *_ in odd_rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    docs = sorted(((i is not None, i or 0, h[t or ""], t or "", i) for i, t, *_ in odd_rows), key=lambda d: d[:4])
    want = Counter()
    for k, (*_, text, i) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (sampler.signature(t) for t in (text, edited, after))
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_of(text), print_of(edited), float((a == b).mean()), float((a == c).mean()))] += 1
    assert Counter(tuple(r) for r in found) == want


def test_many_rows_of_one_id_are_many_ranges(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(4000)] + [(None, "none")], "doc_id long, text string")
    ranges = fingerprints.beside_next(docs).where("role = 0").groupBy("range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 3000
    assert fingerprints.compared(docs).count() == 4001


def test_op4_whole_query(spark, folder, odd_rows):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    found = packing.op4_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_packing_ties_and_columns(spark):
    parts = spark.createDataFrame([(i, 1024, "x") for i in range(400)] + [(400 + i, 1, "x") for i in range(5000)], "doc_id long, length int, sequence_id string").withColumns({c: F.lit(1) for c in ("offset", "row", "id", "size", "kind", "part", "place", "with")})
    found = packing.packed(parts)
    assert found.select(F.countDistinct("sequence_id")).first()[0] <= 103 and found.count() == 5400
    assert set(found.columns) == set(parts.columns)


def test_op6_whole_query(spark, folder, odd_rows):
    def shard(key, n):
        def h(s):
            x = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42) if key is not None else 42
            for v in (s, 23):
                x = xxhash.xxh64_intdigest(struct.pack("<i", v), seed=x)
            return (x - 2**64 if x >= 2**63 else x, s)

        return max(map(h, range(n)))[1]

    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", shard(i, 24), shard(i, 25)) for i, t, *_ in odd_rows)
    found = sharding.op6_sharding(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == want
    slots: dict[int, list] = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_map_columns(spark, tmp_path):
    docs = spark.range(300).select((F.col("id") % 100).alias("doc_id"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    sharding.write_shards(docs, f"{tmp_path}/s", 4, F.lit(8).cast("long"))
    found = sharding.read_shards(spark, f"{tmp_path}/s", docs).collect()
    assert Counter((r["doc_id"], r["m"]["a"]) for r in found) == Counter((i % 100, i) for i in range(300))
    slots = {s: sorted(r["slot"] for r in found if r["shard"] == s) for s in {r["shard"] for r in found}}
    assert all(v == list(range(len(v))) for v in slots.values())


def test_multiplied_rows_are_told_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n, once = docs.count(), near_dedup.deduplicated(docs, size=5).count()
    twice = docs.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    joined = docs.join(spark.range(2), F.lit(True)).drop("id")
    for rows in (twice, docs.unionByName(docs), joined):
        assert numbered(rows).select("uid").distinct().count() == 2 * n
        assert pii.sanitised(rows).count() == 2 * n
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).count()  # linked with nothing, their copies as well
    assert near_dedup.deduplicated(twice, size=5).count() == once + wordless
    assert numbered(docs.where("doc_id > 0").select("doc_id")).select("uid").distinct().count() == docs.where("doc_id > 0").count()


def test_op3_whole_query(spark, folder, odd_rows):
    found = source_mixing.op3_source_mixing(spark, folder).collect()
    sizes = [(i, len((t or "").split()), s) for i, t, _, s, _ in odd_rows]
    by = Counter()
    for _, n, s in sizes:
        by[s] += n
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), (5.0, 2.0, 1.0, 5.0), strict=True))
    want, free = {}, set(by)
    while free:
        level = (1.5 * sum(by.values()) - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= 2 * by[s]}
        want |= {s: 2.0 * by[s] for s in over} if over else {s: weights[s] * level for s in free}
        free = free - over if over else set()
    place = {(i, n): s for i, n, s in sizes}
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, n) for i, n, _ in sizes)
    for r in found:
        s = place[r["doc_id"], r["size"]]
        assert r["source_size"] == by[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    assert sorted(map(tuple, source_mixing.op3_source_mixing(spark, folder).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_mixing_splits_a_bucket_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BUCKET_ROWS", 20)
    docs = spark.createDataFrame([(None, "s", 3) for _ in range(500)] + [(i, "t", 5) for i in range(50)], "doc_id long, source string, size long").withColumn("uid", F.monotonically_increasing_id())
    clash = docs.withColumns({c: F.lit("extra") for c in ("at", "start", "target", "bucket", "point", "times", "gap", "reach", "of", "part", "slice", "whole")})
    found = source_mixing.mixed(clash, source_mixing.targets(docs)).collect()
    taken = sum(r["times"] * r["size"] for r in found if r["source"] == "s")
    target = next(r["target"] for r in found if r["source"] == "s")
    assert len(found) == 550 and abs(taken - target) <= 3 and all(r["bucket"] == r["at"] == "extra" for r in found)


def test_nothing_is_left_in_the_scratch_folder(spark, folder):
    source_mixing.op3_source_mixing(spark, folder).count()
    packing.op4_packing(spark, folder).count()
    sharding.op6_sharding(spark, folder).count()
    left = Path(shared_folder(spark).removeprefix("file:"), "scratch")
    assert not left.exists() or not list(left.iterdir())


def test_op10_whole_query(spark, folder, odd_rows):
    """Rows of one id or of none are rows of their own: plain components of row numbers, then the smallest id of each."""
    rows = [(k, t) for k, (_, t, *_) in enumerate(odd_rows)]
    parts = plain_components(rows, 2, 80)
    ids = [r[0] for r in odd_rows]
    least: dict[int, int | None] = {}
    for k, (_, top) in parts.items():
        known = [i for i in (least.get(top), ids[k]) if i is not None]
        least[top] = min(known, default=None)
    want = Counter((ids[k], n, least[top] if n else ids[k]) for k, (n, top) in parts.items())
    found = near_dedup.op10_near_dedup(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want


def test_outsiders_of_a_band_are_joined_by_few_links(spark):
    assert near_dedup.joining(iter([("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("d", "e"), ("e", "a")])) == [("a", "b"), ("b", "c"), ("d", "e"), ("e", "a")]


def plain_grams(text):
    """Hashed n-grams of 1 to 3 characters, a character at a time."""
    marked, out = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ", Counter()
    squeezed = [c for k, c in enumerate(marked) if c != " " or k == 0 or marked[k - 1] != " "]
    for n in (1, 2, 3):
        for k in range(len(squeezed) - n + 1):
            key = 0
            for j, c in enumerate(squeezed[k : k + n]):
                key = (key * 0x9E3779B1 + ord(c) + j + 1) % 2**32
            out[((key ^ (key >> 15)) * 0x85EBCA6B % 2**32) >> 17] += 1
    return out


def test_language_scores_of_a_model(spark):
    for text in ("One two, 3 été!", "x", "ab ab"):
        at, counts = language_id.grams(text)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == dict(plain_grams(text))
    draw = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], draw.normal(size=(3, language_id.PLACES)), np.ones(language_id.PLACES), 0.7)
    for text in ("One two, 3 été!", "ab ab"):
        x = {p: 1 + math.log(n) for p, n in plain_grams(text).items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / length * model.weights[p, i] for p, v in x.items()) / 0.7 for i in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        name, score = model.predict(text)
        assert name == "abc"[z.index(max(z))] and score == pytest.approx(max(e) / sum(e))


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    parts = plain_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {min((i for i in parts if parts[i][1] == parts[j][1]), default=j) if parts[j][0] else j for j in parts}
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns
    light = numbered(docs).select("uid", "row.doc_id", "row.source", source_mixing.words(F.col("row.text")).alias("size"))
    times = {r["doc_id"]: r["times"] for r in source_mixing.mixed(light, source_mixing.targets(light)).collect()}
    text = {r["doc_id"]: r["text"] for r in rows}
    found = mixed.collect()
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, n in times.items() if n}) and all(r["text"] == text[r["doc_id"]] for r in found)
    model = language_id.fit(docs)
    sure = {r["doc_id"] for r in language_id.predicted(docs, model).where(f"score >= {corpus_pipeline.MIN_SCORE} and lang_pred <> 'und'").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == sure


def test_columns_of_other_operators_may_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", "<p>x")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "tokens", "uid", "confidence", "found", "bad", "rule")})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["rule"], r["verdict"]) for r in url_filters.judge(pages, none).collect()] == [("net/es/", "block")]
    vectors = spark.createDataFrame([(1, [1]), (50, [2])], "vec_id long, x array<long>").withColumns({c: F.lit(1) for c in ("b", "role", "d", "id", "floor", "score", "rank", "query_id")})
    assert [tuple(r) for r in topk_search.topk(vectors, vectors.where("vec_id = 50")).collect()] == [(50, 1, 1, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.packed(empty.select(F.lit(1).alias("length"))).collect() == []
