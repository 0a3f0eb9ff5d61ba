"""Definitions of source files: blocks of lines with their doc comments and heads, their keys and documents, imports made exact, uses by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.blocks import numbered_lines

#: How a declaration starts, and the length of a document.
DECLARATION = r"^(?:@unsafe )?(def|type|law) ([A-Za-z_][\w.]*)"
LONGEST = 32_000


def extracted(files: DataFrame) -> DataFrame:
    """id, name, kind, start, line, end, doc, head, text and documented of every definition of files (id, text).

    A definition starts at the comment lines directly above its declaration and ends before the next one's, without the blank lines between. Its
    head ends where the declaration's parentheses balance. Two windows over a file's lines find all borders; files are dealt out by id. Both run up
    to the line that they are at, one from the last line backwards: a frame that ends with the file would be read again for every line.
    """
    order, backwards = Window.partitionBy("id").orderBy("line"), Window.partitionBy("id").orderBy(F.desc("line"))
    lines = numbered_lines(files).withColumns({"declares": F.col("content").rlike(DECLARATION), "comment": F.col("content").startswith("#")})
    # a comment belongs to the first line below it that is none
    below = F.last(F.when(~F.col("comment"), F.struct("line", "declares")), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("below", below).withColumn("own", F.when(F.col("below.declares"), F.col("below.line")))
    lines = lines.withColumn("block", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("block is not null")
    inside = Window.partitionBy("id", "block").orderBy("line")
    depth = F.sum(F.when(F.col("line") >= F.col("block"), T.balance(T.without_comment(F.col("content")))).otherwise(0)).over(inside)
    full = F.trim("content") != ""
    rows = lines.withColumn("depth", depth).groupBy("id", "block").agg(
        F.min("line").alias("start"),
        F.max(F.when(full, F.col("line"))).alias("end"),
        F.min(F.when((F.col("line") >= F.col("block")) & (F.col("depth") <= 0), F.col("line"))).alias("closed"),
        F.array_sort(F.collect_list(F.struct("line", "content"))).alias("lines"),
    )
    part = lambda first, last: F.array_join(F.transform(F.filter("lines", lambda x: (x["line"] >= first) & (x["line"] <= last)), lambda x: x["content"]), "\n")
    declaration = F.element_at(F.filter("lines", lambda x: x["line"] == F.col("block")), 1)["content"]
    return rows.select(
        "id",
        F.regexp_extract(declaration, DECLARATION, 2).alias("name"),
        F.regexp_extract(declaration, DECLARATION, 1).alias("kind"),
        "start",
        F.col("block").alias("line"),
        "end",
        part(F.col("start"), F.col("block") - 1).alias("doc"),
        part(F.col("block"), F.coalesce("closed", "end")).alias("head"),
        part(F.col("start"), F.col("end")).alias("text"),
        (F.col("start") < F.col("block")).alias("documented"),
    )


def key(package: Column, module: Column, name: Column) -> Column:
    """The key of a definition: its name alone in the base package, else `package/module:name`."""
    return F.when(package.isNull(), name).otherwise(F.concat(package, F.lit("/"), module, F.lit(":"), name))


def label(hash_: Column, name: Column, version: Column) -> Column:
    """`name@version` of a release, or its hash where it has no name."""
    return F.coalesce(F.concat(name, F.lit("@"), version), hash_)


def documents(definitions: DataFrame, origin: Column) -> DataFrame:
    """The texts that are indexed: with its origin the whole definition (cut to LONGEST characters), its name, and its head."""
    line = lambda *more: F.concat_ws("\n", origin, *more)
    return definitions.select("id", "name", F.substring(line(F.col("text")), 1, LONGEST).alias("code"), line(F.col("name")).alias("named"), F.concat_ws(" ", "head", origin).alias("head_origin"))


def normal_path(path: Column) -> Column:
    """A relative path without `.` and `..` steps; `..` above the top stay."""
    step = lambda done, s: F.when((s == ".") | (s == ""), done).when((s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def exact_imports(imports: DataFrame, releases: DataFrame) -> DataFrame:
    """Adds `exact` to imports (release, directory, target and any others): what an import names, with its release.

    A relative target is resolved in its directory and gets the release in front, unless it leaves the release's top. A target that starts with a known
    hash (releases: hash, name, version) gets that release's label. Anything else stays."""
    resolved = normal_path(F.concat_ws("/", F.nullif("directory", F.lit("")), "target"))
    first = F.substring_index("target", "/", 1)
    rows = imports.join(releases.select("hash", label(F.col("hash"), F.col("name"), F.col("version")).alias("label")), first == F.col("hash"), "left")
    relative = F.col("target").startswith(".")
    exact = F.when(relative & ~resolved.startswith(".."), F.concat("release", F.lit("/"), resolved)).when(~relative & F.col("label").isNotNull(), F.concat("label", F.substring("target", F.length(first) + 1, F.length("target"))))
    return rows.withColumn("exact", F.coalesce(exact, "target")).drop("hash", "label")


def uses(definitions: DataFrame) -> DataFrame:
    """Edges a -> b between definitions of one file (id, name, text): b's name stands as a word in a's text, below its own doc. An inverted index
    of words meets the names, so no definition is compared with all others."""
    words = definitions.select("id", F.col("name").alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0)))).alias("b"))
    return words.join(definitions.select("id", F.col("name").alias("b")), ["id", "b"]).where("a <> b").select("id", "a", "b")
