"""Personal data: patterns find the protected entities, then information-theoretic sanitisation finds the terms that give them away.

Entities are emails, IP addresses, payment cards and phone numbers, by fixed patterns. What they belong to is protected as well, as a group: an
email's domain, the first two numbers of an address, the first six digits of a card, the first five of a phone number. A term is a word of
a document that holds the entity, wherever it stands. It discloses an entity by its pointwise mutual information with it, PMI = log2(N *
n(term, entity) / (n(term) * n(entity))), where all counts are of documents, over all documents and whole texts. No term can reveal more than the
entity's own information, IC = log2(N / n(entity)). A term with PMI >= `disclosure` * IC that goes with the entity in at least `support` different
texts is sensitive: in the documents that hold the entity, every place of it is generalised, or, where it gives the entity away whole (PMI >=
`removal` * IC) and nothing above it is safe, removed.

Generalising climbs to what says less. A number becomes its magnitude. A word becomes the rarest word that subsumes it: one that stands in at least
`SUBSUMED` of the entity's documents, stands in more documents than the term, and isn't itself sensitive there. A word that nothing subsumes
becomes `[WORD]`, unless it gives the entity away whole: then it goes.

Documents that hold no entity are left as they are, although a sensitive term may stand there: alone, without the entity, it tells nothing that could be
found in the corpus but by joining documents. An entity that fewer than `support` different texts hold can't be estimated, and has no terms.

Counting: one pass over all texts writes the documents' entities, for those with any their words with their places, and per task partial counts of words.
Partial counts are flushed when they are many, so memory is bounded. Only entities (and groups) of enough texts go on. Their words are counted once a
text, with the number of its copies, and added up before they are shuffled, so an entity in a third of all documents is no task of its own.

Null text: empty, no spans. The patterns are ASCII and run over the whole text in linear time. Repeated rows are found alike; they count as
documents of their own, but not as different texts. Empty tables give no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, by_batches, numbered, read, staged

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{3,}")
#: Partial counts held by a task.
HELD = 60_000
DISCLOSURE, REMOVAL, SUPPORT, SUBSUMED = 0.8, 0.95, 3, 0.8


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = at = 0
    while (at := text.find("@", max(at, free))) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at += 1


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the valid matches, by start and kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def named(text: str, span: tuple[int, int, int]) -> str:
    """What the entity is, however it is written: letters lower-cased; of cards and phones the digits."""
    found = text[span[0] : span[1]].lower()
    return f"{KINDS[span[2]]}:{found if span[2] < 2 else re.sub('[^0-9]', '', found)}"


def groups(text: str, span: tuple[int, int, int]) -> tuple[str, str]:
    """The entity and the group it belongs to."""
    name = named(text, span)
    kind, _, what = name.partition(":")
    if kind == "email":
        return name, f"domain:{what.rpartition('@')[2]}"
    if kind == "ip":
        return name, f"network:{'.'.join(what.split('.')[:2])}"
    return name, f"{kind}s:{what[: 6 if kind == 'card' else 5]}"


def words_apart(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[int]]:
    """The words, lower-cased, with the starts of their places, but for places that touch a span."""
    out: dict[str, list[int]] = {}
    union, i = covered(spans), 0
    for m in WORD.finditer(text):
        while i < len(union) and union[i][1] <= m.start():
            i += 1
        if i == len(union) or m.end() <= union[i][0]:
            out.setdefault(m[0].lower(), []).append(m.start())
    return out


def covered(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The spans' union, in order, with the kind of the first of each."""
    out: list[list[int]] = []
    for a, b, kind in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, kind])
    return out


FOUND = "file long, place long, doc_id long, base array<struct<start:int,end:int,kind:int>>, cover array<struct<start:int,end:int,kind:int>>, entities array<string>, words array<struct<term:string,at:array<int>>>, hash string, word string, n long"


def _scanned(docs: DataFrame) -> DataFrame:
    """Rows of documents (word null) and partial counts of documents by word (uid null)."""
    columns = [c.split(" ")[0] for c in FOUND.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"file": "Int64", "place": "Int64", "doc_id": "Int64", "n": "Int64"})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            rows = [(None,) * 8 + (w, n) for w, n in counts.items()]
            counts.clear()
            return frame(rows)

        for batch in batches:
            rows = []
            for file, place, doc_id, text in zip(batch["file"], batch["place"], batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                spans = entities(text)
                if not spans:
                    counts.update(set(WORD.findall(text.lower())))
                    rows.append((file, place, doc_id, [], [], None, None, None, None, None))
                    continue
                words = words_apart(text, spans)
                counts.update(words.keys())
                names = sorted({x for span in spans for x in groups(text, span)})
                digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()
                found = [{"term": t, "at": at} for t, at in words.items()]
                listed = lambda xs: [{"start": a, "end": b, "kind": k} for a, b, k in xs]
                rows.append((file, place, doc_id, listed(spans), listed(covered(spans)), names, found, digest, None, None))
            yield frame(rows)
            if len(counts) > HELD:
                yield flush()
        if counts:
            yield flush()

    found = by_batches(docs.select("uid.file", "uid.place", "doc_id", "text"), scan, FOUND)
    return found.select(F.when(F.col("word").isNull(), F.struct("file", "place")).alias("uid"), *columns[2:])


TERMS = "array<struct<start:int,end:int,instead:string>>"


def sensitive(docs: DataFrame, **limits) -> DataFrame:
    """uid, doc_id, base, cover (base without overlaps) and terms (start, end, instead) of docs (uid: a struct that tells rows apart, doc_id, text), with the limits of _told."""
    with Scratch(docs.sparkSession) as stage:
        scan = stage(_scanned(docs))
        rows = scan.where(F.col("word").isNull())
        told = stage(_told(scan, rows, stage, **limits))
        held = rows.where(F.size("entities") > 0).select("uid", "entities", F.explode("words").alias("w")).select("uid", "entities", "w.*")
        mine = held.join(told.select("term").distinct(), "term", "left_semi").select("uid", "term", "at", F.explode("entities").alias("entity"))
        # of several entities that a term tells, the strictest rule counts
        chosen = mine.join(told, ["entity", "term"]).groupBy("uid", "term", "at").agg(F.max("rule")["instead"].alias("instead"))
        place = lambda p: F.struct(p.alias("start"), (p + F.length("term")).cast("int").alias("end"), F.col("instead").alias("instead"))
        spans = chosen.select("uid", F.explode(F.transform("at", place)).alias("span"))
        terms = spans.groupBy("uid").agg(F.sort_array(F.collect_list("span")).alias("terms"))
        out = rows.select("uid", "doc_id", "base", "cover").join(terms, "uid", "left")
        return staged(out.withColumn("terms", F.coalesce(F.col("terms").cast(TERMS), F.array().cast(TERMS))))


def _told(scan: DataFrame, rows: DataFrame, stage: Scratch, disclosure: float = DISCLOSURE, removal: float = REMOVAL, support: int = SUPPORT) -> DataFrame:
    """entity, term and rule (strict, instead): what stands for the sensitive terms."""
    total = float(rows.count())
    some = rows.where(F.size("entities") > 0)
    texts = some.select("hash", F.explode("entities").alias("entity")).groupBy("entity", "hash").agg(F.count("*").alias("copies"))
    known = texts.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_entity")).where(F.col("texts") >= support)
    words = some.select("hash", F.transform("words", lambda w: w["term"]).alias("words")).dropDuplicates(["hash"])
    each = texts.join(known.select("entity", "n_entity"), "entity").join(words, "hash").select("entity", "n_entity", "copies", F.explode("words").alias("term"))
    pairs = each.groupBy("entity", "n_entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    counts = scan.where(F.col("word").isNotNull()).groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("n_term"))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    pmi = F.log2(F.lit(total) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    # a pair that is neither sensitive nor common among the entity's documents has no part in what follows
    tells, common = (content > 0) & (pmi >= F.lit(disclosure) * content), F.col("both") >= SUBSUMED * F.col("n_entity")
    pairs = pairs.join(counts, "term").withColumns({"tells": tells, "whole": pmi >= F.lit(removal) * content, "common": common})
    pairs = stage(pairs.where(F.col("tells") | F.col("common")).select("entity", "term", "n_term", "tells", "whole", "common"))
    above = pairs.where("common and not tells").groupBy("entity").agg(F.min(F.struct("n_term", "term")).alias("above"))
    told = pairs.where("tells").join(above, "entity", "left")
    number = F.concat(F.lit("[10^"), (F.length("term") - 1).cast("string"), F.lit("]"))
    wider = F.when(F.col("above.n_term") > F.col("n_term"), F.concat(F.lit("["), F.col("above.term"), F.lit("]")))
    instead = F.when(F.col("term").rlike("^[0-9]+$"), number).otherwise(F.coalesce(wider, F.when(F.col("whole"), "").otherwise("[WORD]")))
    return told.select("entity", "term", F.struct(F.col("whole").alias("strict"), instead.alias("instead")).alias("rule"))


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """docs with entities replaced by their kind, sensitive terms by what says less or nothing; n_chars, if there, follows the text.

    The other columns travel inside one struct, so none of their names can clash. Texts meet the spans once, and are put together by built-in functions.
    """
    rows = numbered(docs)
    found = sensitive(rows.select("uid", "row.doc_id", "row.text"), **limits)
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cover = F.transform("cover", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["kind"] + 1).alias("instead")))
    found = found.where(F.size("cover") > 0).select("uid", F.array_sort(F.concat(cover.cast(TERMS), "terms")).alias("spans"))

    @F.pandas_udf("string")
    def changed(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else replace(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    # only texts that change go to Python
    new = F.coalesce(changed(F.when(F.col("spans").isNotNull(), F.col("row.text")), F.col("spans")), F.col("row.text"))
    out = rows.join(staged(found), "uid", "left").select("row", new.alias("new"))
    instead = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[instead.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def replace(text: str, spans) -> str:
    """text with each span (start, end, instead) replaced; spans are sorted and don't overlap."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s["start"]], s["instead"]]
        at = s["end"]
    return "".join([*out, text[at:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sensitive(numbered(read(spark, sf_dir, "documents")).select("uid", "row.doc_id", "row.text"))
    one = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ordered = lambda xs: F.array_join(F.transform(F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), one), ",")
    term = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(4).alias("kind")))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(ordered(F.col("base")), 256).alias("base_sha256"), ordered(F.concat("base", term)).alias("spans"))
