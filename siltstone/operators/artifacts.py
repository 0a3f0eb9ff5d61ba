"""What is stored of a release: its definitions with whom they use, in the release and beyond, found by scopes across files and releases.

A word of a definition's text is looked up in the definitions and constructors of its own file; then, part by part, through the aliases of the
file's imports (`B.C.open` goes to what B imports as C), a round of joins a part, until nothing goes on; then in the base release, if the file imports
it. The first scope that has the name wins. What lies in the same release is an edge between definitions, what lies beyond is an external key, which stays
the same for all versions of a package. Joins go by (release, module, name), so no word is compared with all names.

Local names aren't told from others: a parameter called like a definition counts as its use. Repeated rows of files are one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import definitions as D
from siltstone.operators.graph import saved

#: Lines that import, words that name something, and constructors of a type.
IMPORT = r"^import (\S+?)(?:\.[a-z]+)?(?: as ([A-Za-z_]\w*))?\s*$"
WORD = r"[A-Za-z_]\w*(?:\.\w+)*"
CONSTRUCTOR = r"(?m)^\s+([A-Z]\w*)\{"
BASE = "Base"
#: Between release and module where they are one id.
_JOINT = "\n"


def imports(files: DataFrame, releases: DataFrame) -> DataFrame:
    """release, module, alias, to_release, to_module of every import that leads to a known release; an import of the base has the alias ''.

    files: release, module, text. releases: release, name (null: the base), version, hash."""
    line = F.explode(T.lines(F.col("text")))
    found = files.select("release", "module", line.alias("line")).where(F.col("line").rlike(IMPORT))
    found = found.select("release", "module", F.regexp_extract("line", IMPORT, 1).alias("target"), F.regexp_extract("line", IMPORT, 2).alias("called")).distinct()
    directory = F.when(F.col("module").contains("/"), F.regexp_extract("module", "^(.*)/[^/]*$", 1)).otherwise("")
    head, rest = F.substring_index("target", "/", 1), F.regexp_extract("target", "^[^/]*/(.*)$", 1)
    own = T.alias(F.substring_index("target", "@", 1), F.col("target"))
    named = found.withColumns({"head": head, "rest": rest, "alias": F.when(F.col("called") != "", F.col("called")).otherwise(own)})
    base = named.where(F.col("target") == BASE).join(releases.where("name is null").select(F.col("release").alias("to_release")), F.lit(True))
    local = named.where(F.col("target").startswith("."))
    local = local.withColumn("to_module", D.normal_path(F.concat_ws("/", F.nullif(directory, F.lit("")), "target"))).withColumn("to_release", F.col("release"))
    labels = releases.where("name is not null").select(F.concat("name", F.lit("@"), "version").alias("head"), F.col("release").alias("to_release"))
    hashes = releases.where("hash is not null").select(F.col("hash").alias("head"), F.col("release").alias("to_release"))
    beyond = named.where(~F.col("target").startswith(".") & (F.col("target") != BASE)).join(labels.unionByName(hashes).distinct(), "head").withColumn("to_module", F.col("rest"))
    base = base.withColumns({"alias": F.lit(""), "to_module": F.lit(BASE)})
    return reduce(DataFrame.unionByName, [x.select("release", "module", "alias", "to_release", "to_module") for x in (base, local, beyond)]).distinct()


def defined(files: DataFrame) -> DataFrame:
    """release, module, name, kind, documented and body (the text below its comments, without those inside) of every definition."""
    rows = D.extracted(files.select(F.concat_ws(_JOINT, "release", "module").alias("id"), "text").distinct())
    bare = F.array_join(F.transform(T.lines(F.col("text")), lambda x: F.when(x.startswith("#"), "").otherwise(T.without_comment(x))), "\n")
    return rows.select(F.split("id", _JOINT)[0].alias("release"), F.split("id", _JOINT)[1].alias("module"), "name", "kind", "documented", bare.alias("body"))


def names(definitions: DataFrame) -> DataFrame:
    """release, module, called, name: a definition by its own name, and a type by its constructors', unless a definition has that name."""
    own = definitions.select("release", "module", F.col("name").alias("called"), "name")
    made = definitions.where("kind = 'type'").select("release", "module", F.explode(F.regexp_extract_all("body", F.lit(CONSTRUCTOR), F.lit(1))).alias("called"), "name")
    free = made.join(own.select("release", "module", "called"), ["release", "module", "called"], "left_anti")
    return own.unionByName(free.groupBy("release", "module", "called").agg(F.min("name").alias("name"))).distinct()


def words(definitions: DataFrame, operators: dict[str, str]) -> DataFrame:
    """release, module, user, word: what a definition's text names; operators: sign -> the name it stands for."""
    used = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    for sign, name in operators.items():
        used = F.concat(used, F.when(F.contains(F.col("body"), F.lit(f" {sign} ")), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    return definitions.select("release", "module", F.col("name").alias("user"), F.explode(F.array_distinct(used)).alias("word"))


def resolved(found: DataFrame, called: DataFrame, imported: DataFrame) -> DataFrame:
    """release, module, user, word, to_release, to_module, name: where each word that names something leads."""
    key = ["release", "module", "user", "word"]
    names_at = called.select(F.col("release").alias("at_release"), F.col("module").alias("at_module"), F.col("called").alias("rest"), "name")
    ways = imported.where("alias <> ''").select(F.col("release").alias("at_release"), F.col("module").alias("at_module"), F.col("alias").alias("first"), "to_release", "to_module")
    at, done = saved(found.select(*key, F.col("release").alias("at_release"), F.col("module").alias("at_module"), F.col("word").alias("rest"))), None
    while True:
        here = saved(at.join(names_at, ["at_release", "at_module", "rest"], "left"))
        hits = here.where("name is not null").select(*key, F.col("at_release").alias("to_release"), F.col("at_module").alias("to_module"), "name")
        done = hits if done is None else done.unionByName(hits)
        on = here.where(F.col("name").isNull() & F.col("rest").contains(".")).withColumn("first", F.substring_index("rest", ".", 1)).join(ways, ["at_release", "at_module", "first"])
        at = saved(on.select(*key, F.col("to_release").alias("at_release"), F.col("to_module").alias("at_module"), F.expr("substring(rest, length(first) + 2)").alias("rest")))
        if at.isEmpty():
            break
    done = saved(done.distinct())
    bases = imported.where("alias = ''").select("release", "module", "to_release")
    base_names = called.select(F.col("release").alias("to_release"), F.col("module").alias("to_module"), F.col("called").alias("word"), "name")
    rest = found.join(done.select(*key), key, "left_anti").join(bases, ["release", "module"]).join(base_names, ["to_release", "word"])
    return done.unionByName(rest.select(*key, "to_release", "to_module", "name"))


def uses(files: DataFrame, releases: DataFrame, operators: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions; internal uses (release, module, user, to_module, used); external uses (release, module, user, key)."""
    own = saved(defined(files))
    found = resolved(words(own, operators or {}), saved(names(own)), saved(imports(files, releases)))
    found = saved(found.where(~((F.col("release") == F.col("to_release")) & (F.col("module") == F.col("to_module")) & (F.col("user") == F.col("name")))))
    inside = found.where("release = to_release").select("release", "module", "user", "to_module", F.col("name").alias("used")).distinct()
    package = releases.select(F.col("release").alias("to_release"), F.col("name").alias("package"))
    beyond = found.where("release <> to_release").join(package, "to_release")
    return own, inside, beyond.select("release", "module", "user", D.key(F.col("package"), F.col("to_module"), F.col("name")).alias("key")).distinct()


def _listed(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """A definition's targets as a sorted list: as many as its text has words."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(name))


def artifacts(files: DataFrame, releases: DataFrame, operators: dict[str, str] | None = None) -> DataFrame:
    """release, module, name, kind, key, documented, users (definitions of the release that use it), external and used (sorted keys)."""
    own, inside, beyond = uses(files, releases, operators)
    users = inside.groupBy("release", F.col("to_module").alias("module"), F.col("used").alias("name")).agg(F.count("*").alias("users"))
    packages = releases.select("release", F.col("name").alias("package"))
    by = ["release", "module", "name"]
    keys = inside.join(packages, "release").select("release", "module", F.col("user").alias("name"), D.key(F.col("package"), F.col("to_module"), F.col("used")).alias("key"))
    external = beyond.withColumnRenamed("user", "name")
    rows = own.join(packages, "release").join(users, by, "left").join(_listed(external, by, F.col("key"), "external"), by, "left").join(_listed(keys.unionByName(external), by, F.col("key"), "used"), by, "left")
    none = F.array().cast("array<string>")
    key = D.key(F.col("package"), F.col("module"), F.col("name")).alias("key")
    return rows.select(*by, "kind", key, "documented", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("external", none).alias("external"), F.coalesce("used", none).alias("used"))
