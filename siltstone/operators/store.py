"""Releases on disk: each package has one visible release, replaced as a whole, whatever fails on the way.

A table's rows lie in folders by package and release. A new release is written beside the one that is visible; then one small file a package, its marker,
is replaced, which is what readers join with; then the older release's folders go. Before the marker changes readers see all of the old release, after it all of the
new one; what a stopped write leaves behind is seen by no reader and overwritten by the next try. A rerun writes the same rows to the same folders.

An older release never replaces a newer one: of the releases given and visible of a package the highest version stays. What each release adds to the counts of
users lies with it, so a count is the sum over visible releases and equals a recount at any time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.graph import saved

MARKERS = "package string, release string, version string"


@dataclass(frozen=True)
class Store:
    """A folder that driver and executors share."""

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        """Replaces the folders that rows have something for, and no others."""
        dealt = rows.repartition(*by).sortWithinPartitions(*by, *[c for c in rows.columns if c not in by])
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._path(name))

    def visible(self) -> DataFrame:
        """package, release, version: the markers."""
        path = self._path("visible")
        if not self._exists(path):
            return self.spark.createDataFrame([], MARKERS)
        return self.spark.read.schema("release string, version string, package string").parquet(path).select("package", "release", "version")

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of all visible releases. schema: of the columns beside package and release."""
        path = self._path(name)
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{schema}, package string, release string")
        rows = self.spark.read.schema(f"{schema}, package string, release string").parquet(path)
        return rows.join(self.visible().select("package", "release"), ["package", "release"], "left_semi").select(*[c for c in rows.columns if c not in ("package", "release")], "package", "release")

    def accepted(self, releases: DataFrame) -> DataFrame:
        """Of releases (package, release, version) those that become or stay visible: a package's newest, unless what is visible is newer."""
        both = releases.select("package", "release", "version", F.lit(1).alias("new")).unionByName(self.visible().withColumn("new", F.lit(0)))
        order = Window.partitionBy("package").orderBy(F.desc(T.version_order(F.col("version"))), F.desc("new"), F.desc("release"))
        return both.withColumn("place", F.row_number().over(order)).where("place = 1 and new = 1").select("package", "release", "version")

    def stage(self, releases: DataFrame, **tables: DataFrame) -> DataFrame:
        """Writes the rows (package, release and any others) of accepted releases beside what is visible; gives those releases."""
        some = saved(self.accepted(releases))
        for name, rows in tables.items():
            self._write(rows.join(some.select("package", "release"), ["package", "release"], "left_semi"), name, "package", "release")
        return some

    def swap(self, accepted: DataFrame) -> None:
        """Makes the staged releases visible: a package's marker is one file, renamed into place."""
        self._write(accepted.select("package", "release", "version"), "visible", "package")

    def clean(self, *names: str) -> int:
        """Removes the folders of releases that aren't visible; gives their number. Their names come from the folders, not from rows."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        kept, gone = {(r["package"], r["release"]) for r in self.visible().collect()}, 0  # a row a package
        for name in names:
            if not self._exists(self._path(name)):
                continue
            root = jvm.org.apache.hadoop.fs.Path(self._path(name))
            files = root.getFileSystem(conf)
            for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "package=*/release=*")):
                place = found.getPath()
                unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                if (unescaped(place.getParent().getName())[8:], unescaped(place.getName())[8:]) not in kept:
                    gone += files.delete(place, True)
        return gone

    def replace(self, releases: DataFrame, **tables: DataFrame) -> DataFrame:
        """All three steps; gives the releases that became visible."""
        some = self.stage(releases, **tables)
        self.swap(some)
        self.clean(*tables)
        return some


def counted(uses: DataFrame) -> DataFrame:
    """key, users: a count of uses (key, users of one release), added up."""
    return uses.groupBy("key").agg(F.sum("users").cast("long").alias("users"))
