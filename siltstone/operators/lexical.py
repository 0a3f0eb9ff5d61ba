"""Lexical retrieval: BM25 over an index of documents, name matching, fusion and reranking. Rankings are rows (query_id, rank, id, score).

A search reads the index once. The terms asked, with their counts of documents, go to every task; a batch of documents is scored for all queries and
only its best of each query go on, so what is shuffled grows with the batches and not with the documents that share a term with a query. Where the
queries ask more than `ASKED` terms in all, postings and terms meet by shuffles instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.graph import saved

#: Fixed values of the ranking formulas.
K1, B = 1.2, 0.75
RRF_K, RRF_DEPTH, RERANK_DEPTH, MINIMUM_OVERLAP = 60, 100, 50, 0.5
#: Terms of all queries that are sent to the tasks, and sums that a task holds at once.
ASKED, SUMS = 200_000, 1 << 21
#: Bytes of texts whose words a task holds at once, but for one longer text.
TEXTS = 1 << 22


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, text). Words are counted first, so that each distinct word of a document is split once."""
    found = docs.select("id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    return found.select("id", "n", F.explode(T.word_tokens(F.col("word"))).alias("term")).groupBy("id", "term").agg(F.sum("n").alias("tf"))


@dataclass(frozen=True)
class Index:
    """documents: id, length, terms and their tfs, for those with terms; terms: term, df; stats: one row, total and mean length."""

    documents: DataFrame
    terms: DataFrame
    stats: DataFrame


def index(docs: DataFrame) -> Index:
    """The index of docs (id, text), written once to the shared folder: texts are split once, however many queries ask. Documents without terms count.

    Texts are dealt out by id once, and a document's row is counted in its batch. Only where an id stands in several rows are terms grouped by id."""
    rows = saved(_counted(docs.repartition("id")))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        counts = rows.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy("id", F.col("e.terms").alias("term")).agg(F.sum("e.tfs").alias("tf"))
        rows = saved(counts.groupBy("id").agg(F.sum("tf").alias("length"), F.collect_list(F.struct("term", "tf")).alias("e")).select("id", "length", F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs")))
    stats = docs.select("id").join(rows.select("id", "length"), "id", "left").agg(F.count("*").alias("total"), F.avg(F.coalesce("length", F.lit(0))).alias("mean"))
    stats = stats.select("total", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"))
    return Index(rows, saved(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))), saved(stats))


def _counted(docs: DataFrame) -> DataFrame:
    """id, length, terms and their tfs of the rows that have terms. A row's words are counted first, so that each different one is split once."""
    word = re.compile(T.WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for low, high in _runs(np.cumsum(size), TEXTS):
                yield counted(batch.slice(low, high - low))

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        kept, ends, terms, tfs = [], [0], [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            tf: dict[str, int] = {}
            for w, n in Counter(word.findall(text or "")).items():
                for t in (w,) if w.isalpha() and w.islower() else T.tokens_of(w):
                    tf[t] = tf.get(t, 0) + n
            if tf:
                kept.append(i)
                terms += tf
                tfs += tf.values()
                ends.append(len(terms))
        # one text that is cut again: faster than a value for each term
        values = pc.split_pattern(pa.array(["\n".join(terms)] if terms else [], pa.string()), "\n").flatten()
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (values, pa.array(tfs, pa.int64()))]
        length = np.diff(np.append(0, np.cumsum(np.array(tfs, np.int64)))[ends])
        return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(kept, pa.int64())), pa.array(length), *lists], ["id", "length", "terms", "tfs"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, length long, terms array<string>, tfs array<long>")


def _idf() -> Column:
    return F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def impacts(found: Index, documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, impact and the other columns) of the asked terms (term) in documents of the index: BM25 with smoothed idf."""
    others = [c for c in documents.columns if c not in ("terms", "tfs")]
    some = documents.select(*others, F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select(*others, F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    some = some.join(found.terms.join(terms.select("term").distinct(), "term", "left_semi"), "term")
    soft = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    rows = some.crossJoin(F.broadcast(found.stats))  # stats: one row
    return rows.select(*[c for c in others if c != "length"], "term", (_idf() * F.col("tf") * (K1 + 1) / (F.col("tf") + soft)).alias("impact"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def ranked(scores: DataFrame, limit: int, *ties: Column | str) -> DataFrame:
    """Adds rank by falling score, then ties; keeps the first `limit` of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("id",)))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bm25(docs: DataFrame | Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The best documents of each query."""
    found = docs if isinstance(docs, Index) else index(docs)
    asked = query_terms(queries).where("query_id is not null")
    known = asked.join(found.terms, "term").crossJoin(F.broadcast(found.stats)).select("query_id", "term", _idf().alias("idf"))  # stats: one row
    rows = known.limit(ASKED + 1).toPandas()
    hits = scores(found, queries) if len(rows) > ASKED else _best(found, rows, queries.schema["query_id"].dataType.simpleString(), limit)
    return ranked(hits, limit).select("query_id", "rank", "id", "score")


def _best(found: Index, asked: pd.DataFrame, kind: str, limit: int) -> DataFrame:
    """query_id, id, score: of each batch of documents the best `limit` of each query. asked: query_id, term, idf."""
    asked = asked.sort_values("term", kind="stable")
    terms, first, idf = asked["term"].drop_duplicates(), ~asked["term"].duplicated(), asked["idf"]
    names, query = np.unique(asked["query_id"], return_inverse=True)
    values, idf = pa.array(terms, pa.string()), idf[first].to_numpy(float)
    starts = np.append(np.flatnonzero(first), len(asked))  # the queries of term t: query[starts[t] : starts[t + 1]]
    mean = found.stats.first()["mean"]
    id_type = found.documents.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("id").combine_chunks().to_batches()
            for part in batch:
                step = max(1, SUMS // max(1, len(names)))
                for at in range(0, part.num_rows, step):
                    yield from best(part.slice(at, step))

    def best(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, listed = part.num_rows, part.column("terms")
        doc = np.repeat(np.arange(n), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(listed.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
        tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
        some = code >= 0
        doc, code, tf = doc[some], code[some], tf[some]
        soft = K1 * (1 - B + B * part.column("length").to_numpy(zero_copy_only=False) / mean)
        impact = idf[code] * tf * (K1 + 1) / (tf + soft[doc])
        sums, held = np.zeros(len(names) * n), starts[code + 1] - starts[code]
        ends = np.cumsum(held)
        # entries are spread over the queries of their terms, at most about SUMS at once
        for low, high in _runs(ends, SUMS):
            own, before = held[low:high], ends[low:high] - held[low:high]
            at = np.arange(own.sum()) - np.repeat(before - before[:1], own) + np.repeat(starts[code[low:high]], own)
            sums += np.bincount(query[at] * n + np.repeat(doc[low:high], own), np.repeat(impact[low:high], own), len(sums))
        sums = np.round(sums.reshape(len(names), n), 6)
        kept = np.partition(sums, n - limit, axis=1)[:, [n - limit]] if limit < n else 0.0
        q, at = np.nonzero((sums >= kept) & (sums != 0))
        order = np.lexsort((at, -sums[q, at], q))
        q, at = q[order], at[order]
        some = np.arange(len(q)) - np.searchsorted(q, q) < limit
        q, at = q[some], at[some]
        out = {"query_id": pa.array(names[q]), "id": part.column("id").take(pa.array(at)), "score": pa.array(sums[q, at])}
        yield pa.RecordBatch.from_pydict(out)

    return found.documents.mapInArrow(run, f"query_id {kind}, id {id_type}, score double")


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose running sums grow by at most about `most`."""
    low = 0
    while low < len(ends):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield low, high
        low = high


def scores(docs: DataFrame | Index, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, id, score of every document with a term of the query, or of the given pairs (query_id, id) alone."""
    asked = query_terms(queries)
    found = docs if isinstance(docs, Index) else index(docs)
    if pairs is None:
        hits = asked.join(impacts(found, found.documents, asked), "term")
    else:
        hits = impacts(found, pairs.select("query_id", "id").distinct().join(found.documents, "id"), asked).join(asked, ["query_id", "term"])
    return hits.groupBy("query_id", "id").agg(F.round(F.sum("impact"), 6).alias("score")).where(F.col("score") != 0)


def name_match(names: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Names whose token sets overlap a query's by half or more; only names that share a token are compared."""
    sets = lambda df, key: df.select(key, F.array_distinct(T.tokens(F.col("text"))).alias("set"))
    n, q = sets(names, "id"), sets(queries, "query_id")
    shared = q.select("query_id", F.size("set").alias("asked"), F.explode("set").alias("t")).join(n.select("id", F.size("set").alias("own"), F.explode("set").alias("t")), "t")
    both = shared.groupBy("query_id", "id").agg(F.count("*").alias("both"), F.first("asked").alias("asked"), F.first("own").alias("own"))
    scores = both.select("query_id", "id", F.round(F.col("both") / (F.col("asked") + F.col("own") - F.col("both")), 6).alias("score"))
    return ranked(scores.where(F.col("score") >= MINIMUM_OVERLAP), limit).select("query_id", "rank", "id", "score")


def fused(rankings: list[DataFrame], limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion; equal scores stay in first-seen order, ranking by ranking."""
    rows = None
    for i, r in enumerate(rankings):
        own = r.select("query_id", "id", F.lit(i).alias("pipeline"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    scores = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("pipeline", "rank")).alias("seen"))
    return ranked(scores, limit, "seen", "id").select("query_id", "rank", "id", "score")


def max_normalised(scores: DataFrame) -> DataFrame:
    """Scores by the query's best; 0 where that is not positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def reranked(candidates: DataFrame, features: list[tuple[float, DataFrame]], limit: int = 10) -> DataFrame:
    """Candidates (query_id, rank, id) by the weighted sum of features (query_id, id, score); missing scores are 0, ties keep the candidates' order."""
    rows, total = candidates.select("query_id", "id", F.col("rank").alias("before")), F.lit(0.0)
    for i, (weight, scores) in enumerate(features):
        rows = rows.join(scores.select("query_id", "id", F.col("score").alias(f"s{i}")), ["query_id", "id"], "left")
        total = total + weight * F.coalesce(F.col(f"s{i}"), F.lit(0.0))
    return ranked(rows.withColumn("score", F.round(total, 6)), limit, "before").select("query_id", "rank", "id", "score")
