"""Queries on releases of many files that import each other. The files are made of the part table: ten parts a file, four files a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import artifacts as A
from siltstone.plans.registry import query
from siltstone.sources.tables import table

NAT = "type Nat is Data:\n  Zero{}\n  Succ{pred: Nat}\n\ndef Nat.add(a: Nat, b: Nat) -> Nat:\n  a\n"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """release, module, text. A part's definition uses the one before it, in its file or through the import of the file before; every tenth, in the middle of a
    file, one two files before, through two imports; every fourth adds, which stands for a name of the base."""
    k, m = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    before = F.when(k % 10 != 0, name(k - 1)).otherwise(F.concat(F.lit("P."), name(k - 1)))
    far = F.when(k % 10 == 5, F.concat(F.lit("  P.P."), name(k - 20), F.lit("(x)\n"))).otherwise("")
    adds = F.when(k % 4 == 0, "  (x + x) # f0\n").otherwise("")
    chunk = F.concat(F.lit("# "), "p_name", F.lit(".\ndef "), name(k), F.lit("(x: Nat) -> Nat:\n  "), before, F.lit("(x)\n"), far, adds, F.lit("\n"))
    rows = table(spark, sf, "part").select(m.alias("m"), k.alias("k"), chunk.alias("chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk"))), lambda x: x["chunk"]), "")
    word = F.col("m").cast("string")
    last = (F.col("m") - 1).cast("string")
    beyond = F.concat(F.lit("import kit"), F.floor((F.col("m") - 1) / 4).cast("string"), F.lit("@1.0/m"), last, F.lit(".src as P\n\n"))
    path = F.when(F.col("m") % 4 == 0, beyond).otherwise(F.concat(F.lit("import ./m"), last, F.lit(".src as P\n\n")))
    made = rows.groupBy("m").agg(text.alias("chunks")).select(F.concat(F.lit("r"), F.floor(F.col("m") / 4).cast("string")).alias("release"), F.concat(F.lit("m"), word).alias("module"), F.concat(F.lit("import Base\n"), path, "chunks").alias("text"))
    return made.unionByName(spark.createDataFrame([("base", A.BASE, NAT)], "release string, module string, text string"))


def releases(spark: SparkSession, sf: str) -> DataFrame:
    number = F.floor(F.col("p_partkey") / 40).cast("string")
    rows = table(spark, sf, "part").select(F.concat(F.lit("r"), number).alias("release"), F.concat(F.lit("kit"), number).alias("name"), F.lit("1.0").alias("version"), F.concat(F.lit("0x"), number).alias("hash")).distinct()
    return rows.unionByName(spark.createDataFrame([("base", None, None, None)], "release string, name string, version string, hash string"))


EDGES = """d AS (SELECT p_partkey AS k, p_partkey // 10 AS m, p_partkey // 40 AS r FROM part),
e AS (SELECT a.k AS a, a.r AS ra, b.k AS b, b.m AS mb, b.r AS rb FROM (SELECT k, r, k - 1 AS t FROM d UNION ALL SELECT k, r, k - 20 FROM d WHERE k % 10 = 5) a JOIN d b ON b.k = a.t)"""


@query(
    "module_artifacts",
    f"""WITH {EDGES}, x AS (SELECT a, 'kit' || rb || '/m' || mb || ':f' || b AS key FROM e WHERE ra <> rb UNION ALL SELECT k, 'Nat' FROM d UNION ALL SELECT k, 'Nat.add' FROM d WHERE k % 4 = 0),
 u AS (SELECT b, count(*) AS users FROM e WHERE ra = rb GROUP BY b), l AS (SELECT a, string_agg(key, ' ' ORDER BY key) AS external FROM x GROUP BY a)
 SELECT 'r' || r AS release, 'm' || m AS module, 'f' || k AS name, 'kit' || r || '/m' || m || ':f' || k AS key, coalesce(users, 0) AS users, external FROM d LEFT JOIN u ON b = k JOIN l ON a = k
 UNION ALL VALUES ('base', 'Base', 'Nat', 'Nat', 1, ''), ('base', 'Base', 'Nat.add', 'Nat.add', 0, '')""",
)
def module_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    found = A.artifacts(files(spark, sf), releases(spark, sf), {"+": "Nat.add"})
    return found.select("release", "module", "name", "key", "users", F.array_join("external", " ").alias("external"))


@query("module_uses", f"WITH {EDGES} SELECT 'r' || ra AS release, 'm' || a // 10 AS module, 'f' || a AS user, 'm' || mb AS to_module, 'f' || b AS used FROM e WHERE ra = rb UNION ALL VALUES ('base', 'Base', 'Nat.add', 'Base', 'Nat')")
def module_uses(spark: SparkSession, sf: str) -> DataFrame:
    return A.uses(files(spark, sf), releases(spark, sf))[1]


@query("module_imports", "SELECT DISTINCT 'r' || p_partkey // 40 AS release, 'm' || p_partkey // 10 AS module, 'r' || (p_partkey // 10 - 1) // 4 AS to_release, 'm' || (p_partkey // 10 - 1) AS to_module FROM part WHERE p_partkey >= 10")
def module_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Where the files' imports lead, those of the base left out; what leads to no file is left out as well."""
    rows, own = files(spark, sf), A.imports(files(spark, sf), releases(spark, sf))
    there = rows.select(F.col("release").alias("to_release"), F.col("module").alias("to_module"))
    return own.where("alias <> \'\'").select("release", "module", "to_release", "to_module").join(there, ["to_release", "to_module"], "left_semi").select("release", "module", "to_release", "to_module")
