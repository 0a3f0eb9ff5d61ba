"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only.

Targets: every source gets a share of the total by weight, at most `max_epochs` times its own size. Sources above that are clamped, the excess
goes to the others by weight, and so on until none is above (each round one small aggregation; every round but the last clamps a source).

Sampling: target / size = whole repetitions of every document, plus a fraction. For the fraction the documents of a source come in the order of
a seeded hash, and each is taken that fits in what is left of the fraction. One more, of all the rest, is the document that best fills the
gap that remains, if it comes nearer than none. So a document too long for the fraction costs no other its place.

This goes in rounds: the documents are taken while their running size stays within the gap; the next round goes on with those behind that fit in
the rest, until none fits. A round's rest is smaller than a document that fitted before it, so in random order the rounds follow the logarithm of
the sizes. The running size goes by buckets of the hash first, so that no source is one task; a bucket that rows of one hash fill (one doc_id and
size many times over, or none) is cut by a hash of the row's place. Only uid, source, size and the hash go through the rounds. Tables by row are
merged, never broadcast: they take little room on disk for what they hold, so Spark would take them for small.

Null text: size 0. Null source: a source of its own, last in order. Sizes all 0, or no rows: targets 0, nothing taken. Repeated rows are
rows of their own. Documents of size 0 take part with 0 words, in the first round. Reruns agree: the hash depends on doc_id, size and seed alone,
and ties go by the row's place. Columns of any other name stay as they are; source_size, target and times of the documents give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, numbered, ranked, read, staged, unit

#: Fixed values of the op3 query.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2.0
#: Rows of a source in a bucket of its hash, about.
BUCKET_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, total: float, max_epochs: float = EPOCHS) -> DataFrame:
    """Adds `target` to sources (weight, source_size): the shares of `total` by weight, none above max_epochs times its size."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    clamped, level = F.lit(False), 0.0
    while True:
        left = sources.select(F.sum(F.when(~clamped, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("fixed"), F.count(F.when(clamped, 1)).alias("n")).first()
        if not left["w"]:
            return sources.withColumn("target", cap)
        level = max(total - left["fixed"], 0.0) / left["w"]
        again = cap <= F.col("weight") * F.lit(level)
        if sources.where(again).count() == left["n"]:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        clamped = again


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, weight and target of each source of docs (source, size)."""
    with Scratch(docs.sparkSession) as stage:
        sizes = stage(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
        total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
        order = ranked(sizes, [F.col("source").asc_nulls_last()], "place", stage)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
        return staged(water_filled(stage(order.withColumn("weight", weight)), total, max_epochs))


def mixed(docs: DataFrame, goals: DataFrame, seed: int = 11) -> DataFrame:
    """Adds source_size, target and `times` (repetitions) to docs: doc_id, source, size, uid and any others.

    uid: distinct for each row and stable; it only breaks ties. goals: the result of targets().
    """
    added = ("source_size", "target", "times")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in added]).alias("row"), "uid")
    return rows.join(repetitions(docs.select("uid", "doc_id", "source", "size"), goals, seed).hint("merge"), "uid").select("row.*", *added)


def repetitions(docs: DataFrame, goals: DataFrame, seed: int = 11) -> DataFrame:
    """uid, source_size, target and `times` of docs (uid, doc_id, source, size), which are light: no text goes along."""
    with Scratch(docs.sparkSession) as stage:
        return staged(_repetitions(docs, goals, seed, stage))


def _repetitions(docs: DataFrame, goals: DataFrame, seed: int, stage: Scratch) -> DataFrame:
    buckets = max(64, -(-docs.count() // BUCKET_ROWS))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goals.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"))
    goal = stage(goal.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")))
    rows = docs.select("uid", "source", "size", unit(F.lit(seed), "doc_id", "size").alias("point"))
    light = rows.withColumn("bucket", F.floor(F.col("point") * buckets))
    # a bucket far beyond its share holds rows of one hash
    full = light.groupBy(F.col("bucket").alias("over")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * BUCKET_ROWS)
    full = stage(full.select("over", F.ceil(F.col("n") / BUCKET_ROWS).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0))
    light = light.join(full, F.col("bucket") == F.col("over"), "left").withColumn("bucket", F.struct("bucket", part.alias("part"))).drop("over", "parts")
    gaps, taken = goal.select("of", "gap"), None
    pool = light
    while True:
        placed = stage(_placed(pool, gaps, stage))
        now = placed.where(F.col("reach") <= F.col("gap")).select("uid", "source", "size")
        if taken is not None and now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        got = now.groupBy(F.col("source").alias("at")).agg(F.sum("size").alias("got"))
        left = gaps.join(got, F.col("of").eqNullSafe(F.col("at")) & F.col("got").isNotNull(), "left")
        gaps = stage(left.select("of", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")))
        pool = placed.where((F.col("reach") > F.col("gap")) & (F.col("size") > 0)).drop("gap", "reach")
    taken = stage(taken.select("uid", F.lit(1).alias("once")))
    off = F.abs(F.col("gap") - F.col("size"))
    near = light.where("size > 0").join(gaps, F.col("source").eqNullSafe(F.col("of"))).where(off < F.col("gap")).join(taken.hint("merge"), "uid", "left_anti")
    fill = near.groupBy("of").agg(F.min_by("uid", F.struct(off, F.col("point"), F.col("uid"))).alias("uid")).select("uid", F.lit(1).alias("once"))
    out = rows.join(goal.drop("gap"), F.col("source").eqNullSafe(F.col("of")), "left").join(stage(taken.unionByName(fill)).hint("merge"), "uid", "left")
    return out.select("uid", "source_size", "target", (F.col("whole") + F.coalesce("once", F.lit(0))).cast("int").alias("times"))


def _placed(pool: DataFrame, gaps: DataFrame, stage: Scratch) -> DataFrame:
    """The rows of pool that fit in their source's gap, with `gap` and `reach`, their running size in the order of the hash."""
    fits = pool.join(gaps, F.col("source").eqNullSafe(F.col("of"))).where(F.col("size") <= F.col("gap")).drop("of")
    slices = fits.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(slices.select(F.col("source").alias("at"), F.col("bucket").alias("slice"), before.alias("start")))
    dealt = fits.join(starts, F.col("source").eqNullSafe(F.col("at")) & (F.col("bucket") == F.col("slice")))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("point", "uid").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("reach", F.col("start") + inside).drop("at", "slice", "start")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as stage:
        light = stage(numbered(read(spark, sf_dir, "documents")).select("uid", "row.doc_id", "row.source", words(F.col("row.text")).alias("size")))
        out = mixed(light, targets(light))
        return staged(out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")))
