"""Source divergence audit: how far the terms of each source lie from its language's and from the other sources', by count-cell ranking.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least LEAST of its documents
have. A group is a language's source; p = 1 + floor(SCALE * (count + 1) / (N + V)) is a term's share in a group or language, N the kept terms
it holds, V the terms kept. Two shares diverge by floor((p - q)^2 / q). Everything is integers, in decimals where a long might not hold it.

Cells. A divergence depends on two counts alone, so terms with equal counts are one cell with a multiplicity, and it is evaluated once a cell:
- `term`: cells (count in the group, count in the language). Equal values are merged, the values ranked by cumulative multiplicity, and only
  the terms of cells that begin before TOP are looked up again, in UTF-8 order.
- `pair`: cells (count in a source, count in another) of the terms that both have; terms that only one has, or none, follow from the number of
  each source's terms by count. So no row is made for a term that a source lacks.

Scale. Batches of texts are counted by group before anything is shuffled; the only shuffle of terms goes by (language, term), a row a source and
flush, so a frequent term or a hot source is no hot key. What a Python worker holds is bounded by HELD terms. Cells are counted map-side.
Rankings are cut to TOP values or rows before their shuffle.

Null text, language and source read as ''. A group without terms, and one of a language that keeps none (V = 0), have their pairs, with value 0
where V is 0. Repeated rows are documents of their own. Ties of value go by UTF-8 order. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.oracles import LOWER, UPPER
from siltstone.llm.shared import BATCH_ROWS, Scratch, read, staged

SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Distinct terms by group that a worker counts before it hands them on.
HELD = 400_000
#: Bytes to bytes: A-Z to lower case, whatever stands between terms to a blank. Bytes from 0x80 are parts of characters beyond ASCII.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """count: occurrences of a term in a group; docs: documents of the group that have it. A group itself is a row without term."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, own in counts.items():
            names = list(own)
            n = len(names) + 1
            arrays = [pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array([None, *names], pa.binary()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(docs[key].__getitem__, names)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=_COUNTED)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = lang or "", source or ""
            if key not in counts:
                counts[key], docs[key] = Counter(), Counter()
            found = terms(text or "")
            counts[key].update(found)
            docs[key].update(set(found))
            if len(counts[key]) > HELD:
                yield from out()
        if sum(map(len, counts.values())) > HELD:
            yield from out()
    yield from out()


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, count, lang_count of the kept terms, `first` at one of a term's rows; a row without term for each group."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    raw = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term binary, count long, docs long")
    # by term alone, though rows are summed by source as well: one shuffle serves the sums and the windows
    groups = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = groups.select("lang", "source", F.col("term").cast("string").alias("term"), "count", F.sum("count").over(term).alias("lang_count"), F.sum("docs").over(term).alias("lang_docs"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return every.where(F.col("term").isNull() | (F.col("lang_docs") >= least)).drop("lang_docs")


def _share(count: str, total: str, kept: str = "v") -> F.Column:
    """Beyond a long where counts are: decimals, whose integer quotient is a long."""
    return F.expr(f"1L + ({SCALE} * (cast({count} as decimal(19)) + 1)) div (cast({total} as decimal(19)) + {kept})")


def _apart(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def totals(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, n, v of the languages, and lang, source, n of the groups."""
    has = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.when(has & F.col("first"), 1)).alias("v"), F.count(F.when(has, 1)).alias("own"))
    return groups.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), groups.select("lang", "source", "n", "own")


def marked(kept: DataFrame, langs: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: each group's terms above their language's share, the `top` that diverge most."""
    cells = kept.where("term is not null").groupBy("lang", "source", "count", "lang_count").agg(F.count("*").alias("terms"))
    shares = cells.join(groups.select("lang", "source", F.col("n").alias("group_n")), ["lang", "source"]).join(langs, "lang")
    shares = shares.withColumns({"p": _share("count", "group_n"), "q": _share("lang_count", "n")}).where("p > q")
    valued = shares.select("lang", "source", "count", "lang_count", "terms", _apart("p", "q").alias("value"))
    by_value = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    group = Window.partitionBy("lang", "source")
    # each value has a term at least, so what ranks beyond `top` values can't begin before `top` terms
    first = by_value.withColumn("at", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("at") <= top)
    before = F.sum("terms").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    limits = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    chosen = valued.join(limits, ["lang", "source"]).where("value >= least").select("lang", "source", "count", "lang_count", "value")
    found = kept.where("term is not null").join(chosen, ["lang", "source", "count", "lang_count"]).select("lang", "source", F.col("term").alias("item"), "value")
    return found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def apart(kept: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the divergence of each source from each other source of its language, over all kept terms."""
    rows = kept.where("term is not null").select("lang", "term", "source", "count")
    by_count = rows.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"))
    sides = groups.join(langs.select("lang", "v"), "lang")
    mine = sides.select("lang", "source", F.col("n").alias("n1"), F.col("own").alias("own1"), "v")
    other = sides.select("lang", F.col("source").alias("item"), F.col("n").alias("n2"), F.col("own").alias("own2"))
    # the result has a row for every two sources of a language; nothing larger is made from it
    pairs = mine.join(other, "lang").where("source <> item")
    none = pairs.where("v > 0").withColumns({"p0": _share("0", "n1"), "q0": _share("0", "n2")})
    here = none.join(by_count, ["lang", "source"]).select("lang", "source", "item", F.expr("terms").alias("m"), _share("count", "n1").alias("p"), F.col("q0").alias("q"))
    there = none.join(by_count.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr("terms").alias("m"), F.col("p0").alias("p"), _share("count", "n2").alias("q"))
    nowhere = none.select("lang", "source", "item", F.expr("v - own1 - own2").alias("m"), F.col("p0").alias("p"), F.col("q0").alias("q"))
    alone = here.unionByName(there).unionByName(nowhere).select("lang", "source", "item", (F.col("m") * _apart("p", "q")).alias("part"))
    # terms of both sources, each two sources once; then both directions
    a, b = rows.select("lang", "term", F.col("source").alias("s1"), F.col("count").alias("c1")), rows.select("lang", "term", F.col("source").alias("s2"), F.col("count").alias("c2"))
    cells = a.join(b, ["lang", "term"]).where("s1 < s2").groupBy("lang", "s1", "s2", "c1", "c2").agg(F.count("*").alias("m"))
    sizes = groups.select("lang", "source", "n")
    shared = cells.join(sizes.select("lang", F.col("source").alias("s1"), F.col("n").alias("n1")), ["lang", "s1"]).join(sizes.select("lang", F.col("source").alias("s2"), F.col("n").alias("n2")), ["lang", "s2"]).join(langs.select("lang", "v"), "lang")
    shared = shared.withColumns({"p": _share("c1", "n1"), "q": _share("c2", "n2"), "p0": _share("0", "n1"), "q0": _share("0", "n2")})

    def beyond(p: str, q: str, p0: str, q0: str) -> F.Column:
        """What a term of both sources adds to the sums of terms that only one has, none having counted it once in each."""
        return F.col("m") * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))

    both = shared.groupBy("lang", "s1", "s2").agg(F.sum(beyond("p", "q", "p0", "q0")).alias("x"), F.sum(beyond("q", "p", "q0", "p0")).alias("y"))
    both = both.select("lang", F.col("s1").alias("source"), F.col("s2").alias("item"), F.col("x").alias("part")).unionByName(both.select("lang", F.col("s2").alias("source"), F.col("s1").alias("item"), F.col("y").alias("part")))
    zero = pairs.select("lang", "source", "item", F.lit(0).cast("long").alias("part"))
    value = alone.unionByName(both).unionByName(zero).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    return value.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    with Scratch(docs.sparkSession) as stage:
        kept = stage(counted(docs, least))
        langs, groups = (stage(x) for x in totals(kept))
        parts = [(name, f(kept, langs, groups)) for name, f in (("pair", apart), ("term", lambda *x: marked(*x, top)))]
        every = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in parts]
        return staged(every[0].unionByName(every[1]))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(read(spark, sf_dir, "documents"))


def oracle() -> str:
    share = lambda c, n: f"(1 + (CAST({SCALE} AS HUGEINT) * ({c} + 1)) // ({n} + v))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.c AS lc, coalesce(x.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
n AS (SELECT lang, source, sum(c) AS n, sum(lc) AS ln, count(*) AS v FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, term, c, {share("c", "n")} AS p, {share("lc", "ln")} AS q FROM c JOIN n USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
