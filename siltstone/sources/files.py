"""Sources of files and listings: manifests, globs, texts of folders, and what is new among listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGEST = "^[0-9a-f]{64}$"
SEGMENTS = r"^[A-Za-z0-9_-][A-Za-z0-9._-]*(?:/[A-Za-z0-9_-][A-Za-z0-9._-]*)*$"


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of every file below a folder; bad bytes become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """id, digest, path, valid of the lines `<digest> <path>` of manifests (id, text)."""
    lines = manifests.select("id", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    rows = lines.select("id", F.substring_index("line", " ", 1).alias("digest"), F.regexp_extract("line", "^[^ ]* (.*)$", 1).alias("path"))
    return rows.withColumn("valid", F.col("digest").rlike(DIGEST) & F.col("path").rlike(SEGMENTS))


def glob(pattern: str) -> str:
    """A regular expression for a glob: with a `/` it fits the whole path, else the last part; `*` stays in a part, `**` doesn't."""
    body = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {r"\*": "[^/]*", r"\?": "[^/]"}.get(m[0], ".*"), re.escape(pattern.lstrip("/")))
    return f"^{body}$" if "/" in pattern else f"(?:^|/){body}$"


def fits(path: Column, *patterns: str) -> Column:
    """Whether a path fits one of the globs and none of those that begin with `!`."""
    wanted = [p for p in patterns if not p.startswith("!")]
    found = F.lit(not wanted)
    for p in wanted:
        found = found | path.rlike(glob(p))
    for p in patterns:
        if p.startswith("!"):
            found = found & ~path.rlike(glob(p[1:]))
    return found


def unknown(listings: DataFrame, known: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Listings whose key isn't known, one per key, the oldest first by `order` among equals."""
    new = listings.join(known.select(key).distinct(), key, "left_anti")
    columns = [c for c in new.columns if c != key]
    return new.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("first")).select(key, "first.*")
