"""Source divergence against a plain version with Python's integers."""

import random
import re
from collections import Counter, defaultdict

from siltstone.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string"


def plain(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, text in rows:
        found = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s in groups:
            value = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in groups if o != s}
            out += [(lang, s, "pair", o, value[o], i + 1) for i, o in enumerate(sorted(value, key=lambda o: (-value[o], o.encode())))]
            apart = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if groups[s][t] and p[s][t] > q[t]}
            out += [(lang, s, "term", t, apart[t], i + 1) for i, t in enumerate(sorted(apart, key=lambda t: (-apart[t], t.encode()))[:top])]
    return sorted(out)


def rows_of(n, seed=2):
    draw = random.Random(seed)
    terms = ["alpha", "Beta", "GAMMA", "ÄÖ", "äö", "日本", "x", "don't", "é", "🙂b", "ßeta", *[f"{a}{b}" for a in "klmnop" for b in "qrstuvwxyz"]]
    return [(i, draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None, "Ü", "z"]), " ".join(draw.choice(terms) + draw.choice(["", ",", "9", "\x00"]) for _ in range(draw.randint(0, 40)))) for i in range(n)]


def test_against_plain_version(spark):
    rows = rows_of(300) + [(1, "en", "a", "alpha " * 5000), (1, "en", "a", "alpha " * 5000), (None, "fr", "lone", "once only"), (None, "fr", None, None), (3, "es", "s", ""), (4, "es", "t", None), (5, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as term", "1 as count", "2 as value")
    for top in (200, 7):
        got = sorted(tuple(r) for r in divergence.audited(docs.repartition(3), top=top).collect())
        assert got == plain(rows, top=top)
    assert divergence.audited(docs.limit(0)).collect() == []


def test_ties_at_the_cut_and_counts_flushed_early(spark, monkeypatch):
    """One value for very many terms: the first of them by UTF-8 stay."""
    rows = [(i, "en", s, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)) + (" mine" if s == "a" else "")) for i, s in enumerate("aaabbb")]
    rows += [(9, "en", "a", " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)))]
    monkeypatch.setattr(divergence, "HELD", 50)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in divergence.audited(docs, top=20).collect()) == plain(rows, top=20)
