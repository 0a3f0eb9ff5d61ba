"""One place to ask a library of texts: search with filters, most used, definitions, files and lines. Every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import blocks, lexical, releases, usage
from siltstone.sources import files


@dataclass(frozen=True)
class Filters:
    """All must hold: packages by name, keys that a definition uses, keys that use it."""

    packages: Sequence[str] = ()
    uses: Sequence[str] = ()
    used_by: Sequence[str] = ()


@dataclass(frozen=True)
class Library:
    """definitions: id, package, path, text; edges: a (user) and b (used), both ids."""

    definitions: DataFrame
    edges: DataFrame

    def narrowed(self, filters: Filters) -> DataFrame:
        """The definitions that pass every filter. Filters narrow before anything is ranked; two packages contradict each other."""
        found = self.definitions
        for p in filters.packages:
            found = found.where(F.col("package") == p)
        for k in filters.uses:
            found = found.join(self.edges.where(F.col("b") == k).select(F.col("a").alias("id")), "id", "left_semi")
        for k in filters.used_by:
            found = found.join(self.edges.where(F.col("a") == k).select(F.col("b").alias("id")), "id", "left_semi")
        return found

    def search(self, words: str = "", filters: Filters | None = None, limit: int = 10) -> DataFrame:
        """By words: best BM25 matches among what the filters leave. By filters alone: the most used. Neither is an error."""
        some = self.narrowed(filters) if filters else self.definitions
        if words.strip():
            asked = some.sparkSession.createDataFrame([(0, words)], "query_id long, text string")
            return lexical.bm25(some.select("id", "text"), asked, limit).select("rank", "id", "score")
        if not filters:
            raise ValueError("a search needs words or filters")
        counts = usage.user_counts(self.edges.select(F.col("a").alias("user"), F.col("b").alias("key")), some.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("users")))
        return usage.most_used(counts, limit, some.select(F.col("id").alias("key"))).select(F.col("key").alias("id"), "users")

    def definition(self, id_: str) -> DataFrame:
        """A definition with its users and uses as sorted lists."""
        one = self.definitions.where(F.col("id") == id_)
        users = self.edges.where(F.col("b") == id_).agg(F.array_sort(F.collect_set("a")).alias("users"))
        uses = self.edges.where(F.col("a") == id_).agg(F.array_sort(F.collect_set("b")).alias("uses"))
        return one.crossJoin(F.broadcast(users)).crossJoin(F.broadcast(uses))  # one row each

    def files(self, *globs: str, offset: int = 0, limit: int = 100) -> DataFrame:
        rows = self.definitions.select("path").distinct().where(files.fits(F.col("path"), *globs))
        return releases.page(rows, [F.col("path")], offset, limit)

    def grep(self, pattern: str, *globs: str, before: int = 0, after: int = 0) -> DataFrame:
        """Matching lines with context, in the files that fit the globs."""
        some = self.definitions.where(files.fits(F.col("path"), *globs)).select(F.col("path").alias("id"), "text")
        return blocks.grep_context(some, pattern, before, after)

    def read(self, path: str, first: int = 1, last: int | None = None, most: int = 2000) -> DataFrame:
        """Lines of a file, at most `most`."""
        end = min(last or first + most - 1, first + most - 1)
        return blocks.numbered_lines(self.definitions.where(F.col("path") == path).select(F.col("path").alias("id"), "text")).where(F.col("line").between(first, end))
