"""Operators against plain versions on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path
from statistics import NormalDist

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import fingerprints, html_text, language_id, near_dedup, packing, pii, sharding, source_mixing, topk_search, url_filters
from siltstone.llm.shared import Scratch, numbered, shared_folder
from tests.llm.conftest import sentence


def test_fp_growth_rules_block_what_labels_say(spark):
    """A combination of tokens is bad, neither alone is."""
    rows = [(i, f"https://{'spam' if i % 2 else 'fine'}.example.org/{'buy' if i % 3 else 'read'}/{i}") for i in range(440)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (i % 2 and i % 3)), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    found = url_filters.judge(pages, labels, rules=[], min_confidence=0.9).collect()
    assert all((r["verdict"] == "block") == bool(r["page_id"] % 2 and r["page_id"] % 3) for r in found)


def test_mined_rules_against_all_subsets(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        own = sorted(x for x in "abcdef" if draw.random() < 0.4)
        bad = draw.random() < (0.95 if {"a", "b"} <= set(own) else 0.9 if "f" in own else 0.1)
        rows.append((i, own, bad))
    labelled = spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean")
    apart = {r["page_id"] for r in labelled.where(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(5)) == 0).collect()}
    with Scratch(spark) as stage:
        got = {tuple(r["items"]): round(r["confidence"], 9) for r in url_filters.mine(labelled, stage).collect()}
    with_tokens = [(set(own), bad, i in apart) for i, own, bad in rows if own]
    sets = [c for k in range(1, 7) for c in combinations("abcdef", k)]

    def counted(c, side):
        hit = [bad for own, bad, a in with_tokens if a == side and set(c) <= own]
        every = [bad for _, bad, a in with_tokens if a == side]
        n, b, total, all_bad = len(hit), sum(hit), len(every), sum(every)
        other, good = total - n, total - all_bad
        return n, b, total, all_bad, (total * b - n * all_bad) ** 2 * total / (n * other * all_bad * good) if n and other and all_bad and good else 0.0

    train = {c: counted(c, False) for c in sets}
    least = max(0.01 * train[sets[0]][2], 5)
    tried = [c for c in sets if train[c][1] >= least]
    z = NormalDist().inv_cdf(1 - 0.01 / len(tried) / 2) ** 2
    kept = {}
    for c in tried:
        n, b, total, all_bad, chi = train[c]
        m, held, _, _, chi_apart = counted(c, True)
        if b / n >= 0.6 and b / n * total / all_bad >= 1.5 and chi >= z and m and held >= 0.6 * m and chi_apart >= NormalDist().inv_cdf(0.995) ** 2:
            kept[c] = b / n
    want = {c: round(p, 9) for c, p in kept.items() if not any(set(k) < set(c) and q >= p for k, q in kept.items())}
    assert got == want and ("f",) in got and ("a", "b") in got


def test_long_shared_urls_are_mined_fast(spark):
    """Twenty words in every URL are one item; the rules are those of the words that tell pages apart, each word of one item a rule."""
    shared = "/".join(f"w{chr(97 + k)}" for k in range(20))
    rows = [(i, f"https://www.site.example.com/{shared}/{['read', 'buy/now'][i % 2]}/{['x', 'y', 'z'][i % 3]}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not i % 2), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    url_filters.judge(pages.limit(5), labels, rules=[]).collect()
    began = time.time()
    found = url_filters.judge(pages, labels, rules=[]).collect()
    took = time.time() - began
    assert len(found) == 200 and all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in found)
    labelled = pages.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select("page_id", url_filters.tokens(F.col("url")).alias("tokens"), (F.col("quality") == 0).alias("bad"))
    with Scratch(spark) as stage:
        rules = {tuple(r["items"]) for r in url_filters.mine(labelled, stage).collect()}
    assert rules == {("path=buy",), ("path=now",)}
    assert took < 30, took


def test_labels_that_say_nothing_make_no_rule(spark):
    draw = random.Random(8)
    pages = spark.createDataFrame([(i, f"https://{draw.choice('abcd')}.example.{draw.choice(['org', 'net'])}/{draw.choice('xyz')}/{i}?p=1") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(draw.random() < 0.7), 0) for i in range(250)], "doc_id long, quality int, toxic int")
    assert url_filters.judge(pages, labels, rules=[]).where("verdict = 'block'").count() == 0


def test_longest_rule(spark):
    cases = {
        "http://www.example.com/en/1": ("www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("example.com/en/", "block"),
        "http://notexample.com/en/": ("com/", "allow"),
        "http://x.net/es/q?y#z": ("net/es/", "block"),
        "http://net/fr/": ("net/fr/", "block"),
        "http://x.com": (None, "allow"),
        "http://x.org/en/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, none).collect()}
    assert got == dict(enumerate(cases.values()))


def test_topk_with_queries_dealt_over_copies(spark, monkeypatch):
    """The first pass in many tasks: the results are those of a plain product, repeated and tied vectors included."""
    monkeypatch.setattr(topk_search, "PER_COPY", 7)
    draw = np.random.default_rng(3)
    x = draw.integers(-9, 9, (400, 6))
    vectors = spark.createDataFrame([(i, [int(c) for c in row]) for i, row in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    got = {}
    for r in topk_search.topk(vectors, vectors.where("vec_id % 10 = 0"), 5, block=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    product = x @ x.T
    assert got == {q: sorted((-int(product[q, i]), i) for i in range(400) if i != q)[:5] for q in range(0, 400, 10)}


def test_topk_reads_part_of_the_lists():
    draw = np.random.default_rng(0)
    x = draw.integers(-300, 300, (700, 12))
    x[100:140] = x[3]
    ids = draw.permutation(700)
    block = topk_search.Block(ids, x)
    for i in range(20):
        want = sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(700) if ids[j] != ids[i])[:5]
        for floor in (-np.inf, -want[-1][0]):
            assert block.topk(ids[i], x[i], 5, floor) == [(j, -s) for s, j in want]
    huge = topk_search.Block(ids, x * 10**2).topk(ids[0], x[0] * 10**14, 1)
    assert huge[0][1] == max(int(x[0] @ x[j]) for j in range(700) if ids[j] != ids[0]) * 10**16
    unit = draw.normal(size=(4000, 64))  # no structure at all: the hardest case
    unit = np.floor(256 * unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.int64)
    block, sample = topk_search.Block(np.arange(4000), unit), topk_search.Block(np.arange(1000), unit[:1000])
    for i in range(0, 4000, 200):
        found = block.topk(i, unit[i], 5, sample.topk(i, unit[i], 5)[-1][1])
        scores = unit @ unit[i]
        assert found == [(int(j), int(scores[j])) for j in np.lexsort((np.arange(4000), -scores)) if j != i][:5]
    assert block.read < 0.5 * block.held


def test_topk_over_blocks(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [int(v) for v in draw.integers(-50, 50, 8)]) for i in range(900)] + [(900 + i, [1, 2, 3, 4, 5, 6, 7, 8]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, x array<long>")
    found = topk_search.topk(vectors, vectors.where("vec_id % 50 = 0"), block=200).collect()
    x = np.array([r[1] for r in rows])
    for i in range(0, 1200, 50):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(1200) if j != i)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])] == [(j, -s) for s, j in want]


def test_water_filling(spark):
    rows = [(i, s, 10 + i % 50) for i, s in enumerate(["a"] * 500 + ["b"] * 300 + ["c"] * 200 + ["d"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("uid", F.col("doc_id"))
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    weights, total = {"a": 5, "b": 2, "c": 1, "d": 5}, 1.5 * sum(sizes.values())
    want, free = {}, set(sizes)
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    want |= {s: weights[s] * level for s in free}
    found = source_mixing.mixed(docs, source_mixing.targets(docs)).collect()
    taken = Counter()
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["times"] <= 2
        taken[r["source"]] += r["times"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 10 for s in want)


def test_mixing_goes_on_after_a_document_too_long(spark):
    draw = random.Random(3)
    rows = [(i, None if i % 3 else "s", draw.randint(1, 300)) for i in range(300)] + [(1000 + i, s, 9000) for i in range(3) for s in ("s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("uid", F.monotonically_increasing_id())
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goals = spark.createDataFrame([(s, n, 1.0, 0.3 * n) for s, n in sizes.items()], "source string, source_size long, weight double, target double")
    points = docs.select("doc_id", "source", source_mixing.unit(F.lit(11), "doc_id", "size").alias("point")).collect()
    order = {(r["doc_id"], r["source"]): r["point"] for r in points}
    want, gap = set(), {s: 0.3 * n for s, n in sizes.items()}
    for i, s, n in sorted(rows, key=lambda r: order[r[:2]]):
        if n <= gap[s]:
            gap[s] -= n
            want.add((i, s))
    for s in sizes:
        off, i = min((abs(gap[s] - n), i) for i, of, n in rows if of == s and (i, s) not in want)
        if off < gap[s]:
            want.add((i, s))
    found = source_mixing.mixed(docs, goals).collect()
    assert len(found) == len(rows) and {(r["doc_id"], r["source"]) for r in found if r["times"]} == want
    for s, n in sizes.items():
        assert abs(sum(r["times"] * r["size"] for r in found if r["source"] == s) - 0.3 * n) <= 50


def test_packing_is_gapless_and_tight(spark):
    rows = [(i, random.Random(i).randint(1, 4096)) for i in range(3000)] + [(9000 + i, 4096) for i in range(5)]
    parts = spark.createDataFrame(rows, "doc_id long, length long")
    bins: dict[int, list] = {}
    for r in packing.packed(parts).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(map(len, bins.values())) == len(rows)
    assert len(bins) <= 1.06 * -(-sum(n for _, n in rows) // 4096)


def test_packing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 100)
    test_packing_is_gapless_and_tight(spark)


def test_names_of_containers_keep_the_article():
    text = "<h1>Title</h1><p>A first paragraph, long enough, with commas, to be the article of the page.</p><p>And a second one, which goes on for a while.</p>"
    want = "Title\nA first paragraph, long enough, with commas, to be the article of the page.\nAnd a second one, which goes on for a while."
    for opened, closed in (('<div class="layout has-sidebar">', "</div>"), ('<div id="content" class="no-sidebar">', "</div>"), ('<section class="search-article">', "</section>"), ('<div class="share price">', "</div>"), ("<form>", "</form>")):
        assert html_text.main_text(f"<html><body>{opened}{text}{closed}</body></html>") == want, opened
        assert html_text.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{opened}{text}{closed}<footer>Imprint</footer></body></html>") == want, opened
    assert html_text.main_text(f'<body><div>{text}</div><div class="comments"><p>A reader says, well, quite a lot about it.</p></div><div class="main-sidebar">More</div></body>') == want
    assert html_text.main_text("<body><nav>Only a menu</nav><script>x</script></body>") == ""


def test_ids_are_the_tokenizers():
    encoder = packing.Encoder()
    texts = ["Hello, world's THE x1 22", "ÉCOLE naïve é Straße ΑΣ", "a\x1cb\x85c", "", "tab\tnew\nline  <|endoftext|>", "½ ² ߟ 漢字 'tis we'll", "o'd"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_packed_sequences_hold_the_ids_of_the_file(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [(1, "a <|endoftext|> b"), (2, "c<|startoftext|>d <|ENDOFTEXT|>"), (3, None), (4, "one two three four five six seven eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert packing.Encoder().encode(["a <|endoftext|> b"]) == [np.array([320, 49407, 321], "<u4").tobytes()]
    found = corpus_pipeline.packed(spark, docs, "").collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in rows}
    assert len(found) == len(rows)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]] and r["length"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(r["ids"])


def test_language_held_out(spark):
    draw = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "kéèàl"}
    rows = [(i, " ".join("".join(draw.choice(alphabets[g]) for _ in range(5)) for _ in range(30)), g) for i in range(300) for g in [draw.choice(sorted(alphabets))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 200"))
    found = language_id.predicted(docs.where("doc_id >= 200"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98 and all(0 <= r["score"] <= 1 for r in found)


def test_shards(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    rows = sharding.sharded(docs, 7, F.lit(1000), bucket_bytes=20_000).select("doc_id", "shard", "slot", sharding.shard_of(F.col("doc_id"), 8).alias("grown")).collect()
    by: dict[int, list] = {}
    for r in rows:
        assert r["grown"] in (r["shard"], 7)
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    assert all([d for _, d in sorted(v)] != sorted(d for _, d in v) for v in by.values())


def test_written_shards_hold_whole_documents(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7), "en", "s", i) for i in range(300)] + [(7, "long " * 100_000, None, "s", 1), (None, None, None, None, None)] + [(8, "copy", "en", "s", 4)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    folder = lambda: set(Path(shared_folder(spark), "shards").glob("*"))
    before = folder()
    found = sharding.op6_sharding(spark, str(tmp_path)).collect()
    (written,) = folder() - before
    shards = spark.read.parquet(str(written)).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in shards) == Counter(rows)
    plain = {(r["shard"], r["slot"]): (r["doc_id"], len(r["text"] or "") + 8, zlib.crc32((r["text"] or "").encode())) for r in shards}
    assert len(plain) == len(rows) and plain == {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in found}


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_entities():
    draw = random.Random(3)
    bits = ["1", "2.", "@", "a", ".", "-", "+1", " ", "(", "255.", "4111111111111111", "example", "@b.c", "%", "\n", "é"]
    for _ in range(5000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 30)))
        assert [(a, k, b) for a, b, k in pii.entities(text)] == plain_spans(text)


def test_disclosing_terms(spark):
    """A far word goes with one number in many texts; a rarer one of those texts is above it; common words say nothing."""
    rows = [(i, f"Zyxwvut wrote {sentence(i)}\n{sentence(50 + i)} call about contract{i} at +1 (555) 010-{1000 + i % 2} soon") for i in range(12)] + [(100 + i, sentence(100 + i) + " soon call about at wrote") for i in range(40)]
    rows.append((200, "Zyxwvut alone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.sensitive(numbered(docs).select("uid", "row.doc_id", "row.text"), disclosure=0.6).collect()}
    terms = {rows[i][1][t["start"] : t["end"]] for i in range(12) for t in found[i]["terms"]}
    assert terms == plain_terms(rows, 0.6, 3) and "Zyxwvut" in terms
    assert not any(found[100 + i]["terms"] for i in range(40)) and not found[200]["terms"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, disclosure=0.6).collect()}
    assert "Zyxwvut" not in clean[0] and "[PHONE]" in clean[0] and "contract0" in clean[0] and clean[200] == "Zyxwvut alone" and clean[100] == rows[12][1]


def plain_terms(rows, disclosure, support):
    """The sensitive words as they stand, from nested loops over all documents."""
    words, held = {}, {}
    for i, text in rows:
        spans = plain_spans(text)
        words[i] = {m[0].lower() for m in re.finditer(r"[^\W_]{3,}", text) if all(m.end() <= a or b <= m.start() for a, _, b in spans)}
        for a, k, b in spans:
            digits = re.sub("[^0-9]", "", text[a:b])
            for name in (digits, digits[:5]):
                held.setdefault(name, set()).add(i)
    told = set()
    for docs in held.values():
        for term in set().union(*(words[i] for i in docs)):
            both, n_term = sum(term in words[i] for i in docs), sum(term in w for w in words.values())
            content = np.log2(len(rows) / len(docs))
            if both >= support and len(docs) >= support and content > 0 and np.log2(len(rows) * both / (n_term * len(docs))) >= disclosure * content:
                told |= {m[0] for i in docs for m in re.finditer(r"[^\W_]{3,}", dict(rows)[i]) if m[0].lower() == term}
    return told


def test_generalised_terms(spark):
    number = "+1 (555) 010-2000"
    rows = [(i, f"project Quorl alpha{i} stage 4711 for lab at {number}") for i in range(4)] + [(10 + i, f"project beta{i} for lab") for i in range(6)] + [(20 + i, f"other text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sensitive(numbered(docs).select("uid", "row.doc_id", "row.text")).where("doc_id = 0").first()
    instead = {rows[0][1][t["start"] : t["end"]]: t["instead"] for t in found["terms"]}
    assert instead["4711"] == "[10^3]" and instead["Quorl"] in ("[project]", "[lab]", "[for]") and "for" not in instead and "project" not in instead


def test_fingerprints_estimate_jaccard():
    sampler, errors = fingerprints.Sampler(), []
    for i in range(150):
        a, b = sentence(i, 60) + " the the the", sentence(i, 60 - i % 50) + " the the"
        ca, cb = Counter(a.split()), Counter(b.split())
        errors.append(fingerprints.likeness(sampler.signature(a), sampler.signature(b)) - sum((ca & cb).values()) / sum((ca | cb).values()))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.09
    assert fingerprints.printed(sampler.signature("")) == fingerprints.EMPTY
    few = fingerprints.Sampler(kept=10)
    assert all((few.signature(sentence(i)) == sampler.signature(sentence(i))).all() for i in range(20))


def test_next_documents(spark):
    docs = [(i * 3 % 101, f"text {i} é" * (i % 7)) for i in range(101)]
    found = {r["doc_id"]: r for r in fingerprints.compared(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    docs.sort()
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        assert found[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert found[i]["n_chars"] == len(text)


def test_main_text():
    page = """<html><head><title>T</title><script>if (a<b) x="</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, many, many, of them, and this text is long enough to count, surely, by any measure.</p></div>
    <div id=content><h2>Head &amp; tail</h2><p>One,   two,
    three &lt;b&gt; <b>bold <i>it</i></b> and <a href=x>link</a>.<p>Second paragraph, with more words, and more commas, so that it scores.<ul><li>item one<li>item two</ul></div>
    <aside><p>Related, stories, here, that are long, and full of commas, but beside the point of the page altogether.</p></aside>
    <div class="comments"><p>First, comment, by a reader, of some length, which goes on, and on, and on, and on.</p></div><form><p>Subscribe, now, please</p></form><footer><p>&copy; 2020, us</p></footer></body></html>"""
    assert html_text.main_text(page) == "Head & tail\nOne, two, three <b> bold it and link.\nSecond paragraph, with more words, and more commas, so that it scores.\nitem one\nitem two"
    assert html_text.main_text(None) == html_text.main_text("<nav>x</nav>") == ""


def test_main_text_under_misleading_names():
    body = "<h1>Title</h1><p>" + "A long sentence, with words, that goes on. " * 5 + "</p><p>" + "Another one, of the same kind. " * 5 + "</p>"
    want = html_text.main_text(f"<body>{body}</body>")
    assert want.count("\n") == 2 and len(want) > 350
    side = "<div class='sidebar'><p>Side words, here, that are long enough, to count.</p></div>"
    readers = "<div class='post-comments'><article><h1>Re</h1><p>" + "A reader says, something. " * 60 + "</p></article></div>"
    rest = f"<nav><a href=x>Home</a></nav>{side}{readers}<div class='ad'>Buy, now</div><form><p>Write, to us</p></form>"
    for name in ("layout has-sidebar", "no-sidebar", "search-article", "share price", "social-news", "related-content", "ad-free-reading", "with-comments"):
        assert html_text.main_text(f"<body><div class='{name}'>{body}</div>{rest}</body>") == want, name
        assert html_text.main_text(f"<body><div class='{name}'>{body}{rest}</div></body>") == want, name
        assert html_text.main_text(f"<body><form id=f><div class='{name}'><article>{body}</article>{rest}</div></form></body>") == want, name
    for opened, closed in (("<form>", "</form>"), ("<form><div id=menu><main>", "</main></div></form>"), ("<div class=widget><form><article>", "</article></form></div>")):
        assert html_text.main_text(f"<body>{opened}{body}{closed}{rest}</body>") == want, opened
    plain = body.replace("<h1>Title</h1>", "<p>Title</p>")
    assert html_text.main_text(f"<body><form>{plain}{rest}</form></body>") == want
    for name in ("comments", "reader-comments", "site-header", "search box", "related-posts", "cookie_notice", "main-sidebar", "newsletter-signup", "share-buttons", "ad", "ad-slot-3"):
        long = "Words, that are no article, of any length. " * 40
        assert html_text.main_text(f"<body><article>{body}</article><div class='{name}'><p>{long}</p></div></body>") == want, name
    deep = "<form class=search>" * 20000 + f"<article>{body}</article>"
    assert html_text.main_text(deep) == want


def test_main_text_of_nested_pages():
    long = "A sentence, with commas, of a fair length, that goes on, and on, so that it counts. "
    body = "".join(f"<p>{long}{i}</p>" for i in range(9))
    want = [f"{long}{i}" for i in range(9)]
    links = "<ul><li><a href=x>Other page</a><li><a href=y>Yet another</a></ul>"
    menu = f"<nav>{links}</nav>"
    text = lambda article: html_text.main_text(f"<html><body>{menu}{article}<footer><p>&copy; us</p></footer></body></html>").split("\n")
    assert text(f"<article><h1>Title</h1><div>{body}</div>{links}</article>") == ["Title", *want]
    assert text(f"<article><h1>Title</h1><div class=wrap><div>{body}</div><ul><li>short</ul></div><blockquote>Quote</blockquote>end</article>") == ["Title", *want, "short", "Quote", "end"]
    assert text(f"<article><section>{body}</section><section><p>Short, one.</p><p>Two.</p></section></article>") == [*want, "Short, one.", "Two."]
    assert text(f"<div><h1>Title</h1><div><div>{body}</div></div></div><div>{links}</div>") == ["Title", *want]
    assert text(f"<h1>Title</h1><article>{body}</article>") == ["Title", *want]


def test_broken_markup_is_read_in_linear_time():
    for page in ("<a " * 350_000, "<b><div></x>" * 60_000, "<a \"'>" * 150_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<!--" * 250_000, "<b '\">x<i \">" * 60_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10
    assert html_text.main_text("<p>one <b title='a>b'>two</b> 3 < 4 <p title=\"x>five</p>") == "one two 3 < 4\nfive"


def plain_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    draw, rows = random.Random(1), []
    for g in range(12):
        words = sentence(g, 60).split()
        for k in range(draw.choice([1, 2, 30])):
            some = list(words)
            for _ in range(draw.randint(0, 5)):
                some[draw.randrange(60)] = draw.choice(words)
            rows.append((len(rows), " ".join(some)))
    rows += [(1000, None), (1001, " "), (1002, "one"), (1003, "ONE"), (1004, "one two")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    want = plain_components(rows, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()})


def test_deduplicated_keeps_unique_rows_of_null_and_shared_ids(spark):
    copy = sentence(3, 60)
    near = " ".join([*copy.split()[:-1], "other"])
    rows = [(None, sentence(40)), (None, sentence(41)), (None, None), (None, " "), (None, copy), (5, near), (5, sentence(42)), (5, sentence(43)), (4, copy), (4, copy), (None, sentence(44)), (None, sentence(44))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, uid int")
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.deduplicated(docs).collect())
    assert kept == Counter([(None, sentence(40)), (None, sentence(41)), (None, None), (None, " "), (5, sentence(42)), (5, sentence(43)), (4, copy), (None, sentence(44))])
    found = near_dedup.near_duplicates(docs)
    assert found.where("doc_id is null and kept").count() == 5 and found.count() == len(rows)


def test_min_max_estimates():
    a, b = (near_dedup.shingles(" ".join(f"w{i}" for i in range(k, k + 300)), 2) for k in (0, 30))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = near_dedup.min_max(a, 2000) == near_dedup.min_max(b, 2000)
    assert abs(same.mean() - true) < 0.03
