"""Cross-tokenizer alignment against a plain version that encodes whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from siltstone.llm import alignment

ALPHABET = [*"ab cd  \n\n\t\r.,'s1é▁ß—日 ́ \x1c\x85\x00🙂", "<s>", "<|endoftext|>", "<0x41>", "'s", " the", "word", "　", "ﬁ", "don't ", "12 345"]


def plain(text):
    """Counts (A, B, groups), the groups as printed, and the links."""
    v = alignment._vocabularies(alignment.BYTES, alignment.PIECES)
    raw = f" {text}".encode()
    sides = [(v.a.encode(f" {text}", add_special_tokens=False).ids, v.a_bytes), (v.b.encode(text), v.b_bytes)] if text else []
    if not text or any(b"".join(names[i] for i in ids) != raw for ids, names in sides):
        return (0, 0, 0), "", []
    ends = []
    for ids, names in sides:
        at, own = 0, []
        for i in ids:
            at += len(names[i])
            own.append((at, i))
        ends.append(own)
    common = sorted({p for p, _ in ends[0]} & {p for p, _ in ends[1]})
    groups = ["|".join(",".join(str(i) for p, i in own if s < p <= e) for own in ends) for s, e in zip([0, *common], common, strict=False)]
    return (len(ends[0]), len(ends[1]), len(common)), ";".join(groups), [(i, j) for p, i in ends[0] for q, j in ends[1] if p == q]


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_units_give_what_whole_texts_give():
    aligner, some = alignment.Aligner(kept=50), texts(4000)
    size = len(aligner.of.b_bytes)
    for at in range(0, len(some), 500):
        for text, (counts, groups, links) in zip(some[at : at + 500], aligner.align(some[at : at + 500]), strict=True):
            n, printed, pairs = plain(text)
            assert (tuple(counts), groups.decode(), sorted(links.tolist())) == (n, printed, sorted(a * size + b for a, b in pairs)), repr(text)
    assert len(aligner.known) <= 50 + 2000


def test_printed_bytes_are_the_tokenizers_own():
    v = alignment._vocabularies(alignment.BYTES, alignment.PIECES)
    for text in ("naïve façade, 12 apples\n\tend ", "日本 🙂"):
        assert b"".join(v.a_bytes[i] for i in v.a.encode(text, add_special_tokens=False).ids) == text.encode()
    assert len(set(v.a_bytes)) == len(v.a_bytes) == 50257 and len(v.b_bytes) == 32000


def expected(rows):
    own = [(i, *plain(t)) for i, t in rows]
    links, documents = Counter(), Counter()
    for *_, pairs in own:
        links.update(pairs)
        documents.update(set(pairs))
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for i, n, printed, pairs in own:
        digest = hashlib.sha256(printed.encode()).hexdigest() if printed else ""
        out.append((i, *n, len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), digest))
    return out, links, documents


def test_against_plain_version(spark):
    """Many containers, several planes (a word 3,000 times), long runs of one document, repeated rows, null ids and texts."""
    rows = [(i, t) for i, t in enumerate(texts(300, 2))] + [(7, "the word " * 3000), (7, "the word " * 3000), (None, "the word"), (8, None), (9, ""), (None, None), (10, "the the the the the"), *[(20 + i, "same text here") for i in range(400)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slot", "'x' as container", "'y' as bits", "2 as a")
    want, links, documents = expected(rows)
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    got = [tuple(r) for r in alignment.aligned(docs.repartition(3)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    from siltstone.llm.shared import staged

    index = staged(alignment.indexed(docs, entries_most=500, digest=False))  # containers of few entries
    counts = alignment.pairs(index)
    assert {(r["a"], r["b"]): (r["links"], r["documents"]) for r in counts.collect()} == {p: (n, documents[p]) for p, n in links.items()}
    assert index.where("dense").count() > 0 and index.where("not dense").count() > 0 and index.where("plane > 10").count() > 0
    again = [(*r[:7], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in alignment.scored(index, counts).collect()]
    assert sorted(again, key=key) == sorted(want, key=key)
    assert alignment.aligned(docs.limit(0)).collect() == []


def test_bitmaps_hold_their_slots():
    codes, slots = np.repeat([5, 9, 70_000], [3, 900, 1]), np.array([1, 7, 900, *range(900), 65_535])
    found = {}
    for batch in alignment._planes(codes, slots, 0, 1, 32_000):
        for r in batch.to_pylist():
            bits = np.frombuffer(r["bits"], np.uint8)
            found[r["a"] * 32_000 + r["b"]] = np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() if r["dense"] else bits.view("<u2").tolist()
    assert found == {5: [1, 7, 900], 9: list(range(900)), 70_000: [65_535]}
