"""Structure of texts: lines, blocks of lines, line search with context, windows of neighbours, links and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T


def numbered_lines(docs: DataFrame) -> DataFrame:
    """id, line (from 1), content."""
    return docs.select("id", F.posexplode(T.lines(F.col("text"))).alias("at", "content")).select("id", (F.col("at") + 1).alias("line"), "content")


def line_blocks(lines: DataFrame, starts: Column) -> DataFrame:
    """Blocks: a starting line and all before the next start; lines before the first start belong to none. Trailing blank lines go."""
    order = Window.partitionBy("id").orderBy("line")
    rows = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(order)).where(F.col("block") > 0)
    full = F.trim("content") != ""
    return rows.groupBy("id", "block").agg(F.min("line").alias("first"), F.coalesce(F.max(F.when(full, F.col("line"))), F.min("line")).alias("last"))


def grep(docs: DataFrame, pattern: str) -> DataFrame:
    """Matching lines. Whole texts that can't match are dropped before they are split."""
    some = docs.where(F.col("text").rlike(pattern))
    return numbered_lines(some).where(F.col("content").rlike(pattern))


def grep_context(docs: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """Matching lines with their neighbours; `island` numbers the runs of a text that a separator would part."""
    lines = numbered_lines(docs.where(F.col("text").rlike(pattern))).withColumn("hit", F.col("content").rlike(pattern))
    order = Window.partitionBy("id").orderBy("line")
    near = F.max(F.col("hit").cast("int")).over(order.rowsBetween(-after, before)) == 1
    shown = lines.withColumn("near", near).where("near")
    gap = F.when(F.col("line") - F.lag("line", 1, -1).over(order) > 1, 1).otherwise(0)
    return shown.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order)).select("id", "line", "hit", "island")


def windows(rows: DataFrame, targets: int, before: int, after: int, budget: int) -> DataFrame:
    """Windows of consecutive rows (id, place from 0, text): `targets` of them, with neighbours as context.

    Context is cut to `budget` characters, counted with a line end each, from the targets outward by running sums.
    """
    cut = rows.select("id", "place", (F.length("text") + 1).alias("n"), F.floor(F.col("place") / targets).cast("int").alias("own"))
    # a row serves its own window and those whose context reaches it
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - before - targets + 1) / targets)).cast("int"), F.floor((F.col("place") + after + targets) / targets).cast("int"))
    dealt = cut.withColumn("window", F.explode(reach))
    start, stop = F.col("window") * targets, (F.col("window") + 1) * targets
    role = F.when(F.col("own") == F.col("window"), "target").when((F.col("place") < start) & (F.col("place") >= start - before), "before").when((F.col("place") >= stop) & (F.col("place") < stop + after), "after")
    dealt = dealt.withColumn("role", role).where(F.col("role").isNotNull())
    outward = Window.partitionBy("id", "window", "role").orderBy(F.when(F.col("role") == "before", -F.col("place")).otherwise(F.col("place")))
    kept = dealt.withColumn("run", F.sum("n").over(outward)).where((F.col("role") == "target") | (F.col("run") <= budget))
    counts = [F.count_if(F.col("role") == r).alias(r) for r in ("target", "before", "after")]
    return kept.groupBy("id", "window").agg(*counts, F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("target") > 0)


#: Noncharacters that mark the ends of matches; in a text they are shown as the replacement character, which is as long.
_OPEN, _CLOSE = "﷐", "﷑"


def match_spans(docs: DataFrame, pattern: str) -> DataFrame:
    """id, start, end (characters from 0, end exclusive), first and last (lines from 1) of every match, in whole texts: a match may cross lines.

    A text is cut at its matches; sums of the pieces' characters and line feeds before each give its place, so nothing is split into lines.
    `.` matches line feeds too; a match that ends with one doesn't reach the next line. A pattern that fits the empty text is an error.
    """
    dotall = f"(?s){pattern}"
    if docs.sparkSession.range(1).where(F.lit("").rlike(dotall)).count():
        raise ValueError(f"{pattern} fits the empty text")
    safe = F.translate("text", _OPEN + _CLOSE, "��")
    some = docs.where(F.col("text").rlike(dotall)).select("id", F.regexp_replace(safe, dotall, f"{_OPEN}$0{_CLOSE}").alias("marked"))
    parts = some.select("id", F.posexplode(F.split("marked", _OPEN)).alias("at", "part"))
    hit = F.when(F.col("at") > 0, F.substring_index("part", _CLOSE, 1)).otherwise("")
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    sized = parts.select("id", "at", F.length(hit).alias("n"), feeds(hit).alias("crossed"), hit.endswith("\n").alias("ends"), (F.length("part") - (F.col("at") > 0).cast("int")).alias("size"), feeds(F.col("part")).alias("feeds"))
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "first": F.coalesce(F.sum("feeds").over(before), F.lit(0)) + 1})
    last = F.col("first") + F.col("crossed") - F.col("ends").cast("int")
    return placed.where((F.col("at") > 0) & (F.col("n") > 0)).select("id", "start", (F.col("start") + F.col("n")).alias("end"), "first", last.alias("last"))


def grep_spans(docs: DataFrame, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """id, line, hit, island, content: the lines of all matches with their neighbours; what touches or overlaps is one island, so a line comes once."""
    found = match_spans(docs, pattern).select("id", "first", "last").distinct()
    order = Window.partitionBy("id").orderBy("first", "last")
    reach = F.max(F.col("last") + after).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") - before > reach + 1, 1).otherwise(0)
    islands = found.withColumn("island", F.sum(F.coalesce(opens, F.lit(0))).over(order)).groupBy("id", "island").agg(F.greatest(F.min("first") - before, F.lit(1)).alias("from"), F.max(F.col("last") + after).alias("to"))
    texts = docs.select("id", T.lines(F.col("text")).alias("lines"))
    shown = islands.join(texts, "id").select("id", "island", "from", F.posexplode(F.slice("lines", F.col("from"), F.col("to") - F.col("from") + 1)).alias("at", "content"))
    shown = shown.select("id", "island", (F.col("from") + F.col("at")).alias("line"), "content")
    hits = found.select("id", F.explode(F.sequence("first", "last")).alias("line")).distinct().withColumn("hit", F.lit(True))
    return shown.join(hits, ["id", "line"], "left").select("id", "line", F.coalesce("hit", F.lit(False)).alias("hit"), "island", "content")
