"""Queries on source files: definitions, documents, imports, release artifacts, highlights. The files are made of the part table, one a brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import definitions as D
from siltstone.plans.registry import query
from siltstone.sources.tables import table

#: What stands above, at and below the declaration of a part; a part uses the one of a third of its number.
CHUNK = """SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN ['# ' || p_name || '.', '# More.'] ELSE [] END AS above,
 CASE WHEN p_size % 2 = 0 THEN ['def f' || p_partkey || '(x: Nat,', '    y: (Nat)) -> Nat:'] ELSE ['def f' || p_partkey || '(x: Nat) -> Nat:'] END AS head, '  f' || (p_partkey // 3) || '(x) # f0' AS body FROM part"""
PLACED = f"""c AS ({CHUNK}), s AS (SELECT *, len(above) + len(head) + 2 AS n FROM c), d AS (SELECT *, 3 + coalesce(sum(n) OVER (PARTITION BY brand ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
 e AS (SELECT brand AS id, 'f' || k AS name, k, CAST(start AS INTEGER) AS start, CAST(start + len(above) AS INTEGER) AS line, CAST(start + n - 2 AS INTEGER) AS "end", array_to_string(above, chr(10)) AS doc, array_to_string(head, chr(10)) AS head,
  array_to_string(list_concat(above, head, [body]), chr(10)) AS text, len(above) > 0 AS documented FROM d)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """id (the brand) and text: an import, a blank line and the definitions of the brand's parts."""
    number = F.col("p_partkey").cast("string")
    above = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# "), "p_name", F.lit(".\n# More.\n"))).otherwise("")
    head = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("def f"), number, F.lit("(x: Nat,\n    y: (Nat)) -> Nat:\n"))).otherwise(F.concat(F.lit("def f"), number, F.lit("(x: Nat) -> Nat:\n")))
    body = F.concat(F.lit("  f"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("(x) # f0\n\n"))
    chunks = table(spark, sf, "part").select(F.col("p_brand").alias("id"), "p_partkey", F.concat(above, head, body).alias("chunk"))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "chunk")))
    return chunks.groupBy("id").agg(F.concat(F.lit("import ./nat\n\n"), F.array_join(F.transform(ordered, lambda x: x["chunk"]), "")).alias("text"))


@query("definitions_extracted", f'WITH {PLACED} SELECT id, name, \'def\' AS kind, start, line, "end", doc, head, text, documented FROM e')
def definitions_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return D.extracted(files(spark, sf))


@query(
    "definition_documents",
    f"""WITH {PLACED} SELECT id, name, left(id || chr(10) || text, 32000) AS code, id || chr(10) || name AS named, head || ' ' || id AS head_origin,
 CASE WHEN id = 'Brand#1' THEN name ELSE 'kit/' || id || ':' || name END AS key FROM e""",
)
def definition_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of every definition, with its key; the first brand is the base package."""
    rows = D.documents(D.extracted(files(spark, sf)), F.col("id"))
    return rows.withColumn("key", D.key(F.when(F.col("id") != "Brand#1", F.lit("kit")), F.col("id"), F.col("name")))


USES = f"""{PLACED}, u AS (SELECT a.id, a.name AS a, b.name AS b, a.k FROM e a JOIN e b ON b.id = a.id AND b.k = a.k // 3 AND b.k <> a.k)"""


@query("release_artifacts", f"WITH {USES} SELECT e.id, e.name, e.documented, count(DISTINCT v.a) AS users, coalesce(any_value(w.b), '') AS uses FROM e LEFT JOIN u v ON v.id = e.id AND v.b = e.name LEFT JOIN u w ON w.id = e.id AND w.a = e.name GROUP BY e.id, e.name, e.documented")
def release_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """From files to what is stored of a release: its definitions, with how many use each in its file and what it uses."""
    found = D.extracted(files(spark, sf))
    below = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: T.without_comment(x)))
    e = D.uses(found.select("id", "name", F.regexp_replace(below, r"(?m)^#.*$", "").alias("body")))
    users = e.groupBy("id", F.col("b").alias("name")).agg(F.countDistinct("a").alias("users"))
    used = e.groupBy("id", F.col("a").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("uses"))
    rows = found.select("id", "name", "documented").join(users, ["id", "name"], "left").join(used, ["id", "name"], "left")
    return rows.fillna(0, ["users"]).fillna("", ["uses"])


@query(
    "rebound_keys",
    """SELECT o_custkey AS user, l_partkey AS old, min(n.p_partkey) AS new FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part o ON o.p_partkey = l_partkey
 JOIN part n ON n.p_name = o.p_name AND n.p_brand = o.p_brand AND n.p_partkey > o.p_partkey GROUP BY o_custkey, l_partkey""",
)
def rebound_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of a part's key that a later part of the same name takes over: the next key of the name, looked up once, meets the uses."""
    following = F.lead("p_partkey").over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey"))
    bound = table(spark, sf, "part").select(F.col("p_partkey").alias("old"), following.alias("new")).where("new is not null")
    used = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("old"))
    return used.distinct().join(bound, "old").select("user", "old", "new")


#: Three kinds of target: beside, above the top, and in a release known by its number.
IMPORTS = "SELECT p_partkey AS k, 'r' || p_size AS release, 'src/' || lower(p_type) AS directory, p_size % 3 AS kind, replace(p_name, ' ', '_') AS word, p_size, p_brand FROM part"


@query(
    "exact_imports",
    f"""SELECT k, CASE WHEN kind = 0 THEN release || '/src/' || word WHEN kind = 1 THEN '../../../' || word WHEN p_size < 25 THEN 'kit@' || p_size || '.0/' || word ELSE 'h' || p_size || '/' || word END AS exact FROM ({IMPORTS})""",
)
def exact_imports(spark: SparkSession, sf: str) -> DataFrame:
    word, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    target = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(".././"), word)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("../../../"), word)).otherwise(F.concat(F.lit("h"), size, F.lit("/"), word))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("r"), size).alias("release"), F.concat(F.lit("src/"), F.lower("p_type")).alias("directory"), target.alias("target"))
    known = spark.range(25).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"), F.lit("kit").alias("name"), F.concat(F.col("id").cast("string"), F.lit(".0")).alias("version"))
    return D.exact_imports(rows, known).select("k", "exact")


SPANS = """SELECT l_orderkey AS k, l_linenumber AS line, CAST(l_linenumber AS BIGINT) AS start, CAST(l_linenumber + l_quantity % 4 AS BIGINT) AS "end", l_returnflag AS kind, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS target FROM lineitem"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """k, line and a highlight as text: [start, end, kind, target]."""
    start = F.col("l_linenumber").cast("long")
    end = (F.col("l_linenumber") + F.col("l_quantity") % 4).cast("long")
    target = F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")).otherwise("null")
    text = F.format_string('[%d,%d,"%s",%s]', start, end, F.col("l_returnflag"), target)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), text.alias("text"))


def decoded(text) -> F.Column:
    """start, end, kind, target of a highlight; null where it isn't one: 0 <= start < end and a known kind."""
    x = F.from_json(text, "array<string>")
    found = F.struct(F.get(x, F.lit(0)).try_cast("long").alias("start"), F.get(x, F.lit(1)).try_cast("long").alias("end"), F.get(x, F.lit(2)).alias("kind"), F.get(x, F.lit(3)).try_cast("long").alias("target"))
    return F.when((F.size(x) == 4) & (found["start"] >= 0) & (found["start"] < found["end"]) & found["kind"].isin("A", "N"), found)


@query("highlights_decoded", f"SELECT k, line, \"end\" > start AND kind IN ('A', 'N') AS valid, CASE WHEN \"end\" > start AND kind IN ('A', 'N') THEN \"end\" - start END AS width FROM ({SPANS})")
def highlights_decoded(spark: SparkSession, sf: str) -> DataFrame:
    found = spans(spark, sf).select("k", "line", decoded(F.col("text")).alias("h"))
    return found.select("k", "line", F.col("h").isNotNull().alias("valid"), (F.col("h.end") - F.col("h.start")).alias("width"))


@query("file_highlights", f"SELECT k, string_agg(CASE WHEN \"end\" > start AND kind IN ('A', 'N') THEN line || ':' || start || '-' || \"end\" END, ' ' ORDER BY line, line || ':' || start || '-' || \"end\") AS lines FROM ({SPANS}) GROUP BY k HAVING count(*) FILTER (WHERE \"end\" > start AND kind IN ('A', 'N')) > 0")
def file_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """All highlighted lines of each file, in order."""
    found = spans(spark, sf).select("k", "line", decoded(F.col("text")).alias("h")).where(F.col("h").isNotNull())
    shown = F.concat(F.col("line").cast("string"), F.lit(":"), F.col("h.start").cast("string"), F.lit("-"), F.col("h.end").cast("string"))
    lines = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))).alias("x"))
    return lines.select("k", F.array_join(F.transform("x", lambda r: r["s"]), " ").alias("lines"))


@query("head_highlights", f"WITH h AS (SELECT k, list(kind ORDER BY line, kind) AS x FROM ({SPANS}) GROUP BY k) SELECT o_orderkey AS k, array_to_string(x[2:3], ' ') AS head FROM orders JOIN h ON k = o_orderkey WHERE o_orderstatus = 'F' AND len(x) >= 2")
def head_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """The highlights of a definition's head: files meet their lines by key, and a slice of the lines stays."""
    lines = spans(spark, sf).select("k", "line", F.get(F.from_json("text", "array<string>"), F.lit(2)).alias("kind"))
    x = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "kind"))).alias("x"))
    some = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return some.join(x, "k").where(F.size("x") >= 2).select("k", F.array_join(F.transform(F.slice("x", 2, 2), lambda r: r["kind"]), " ").alias("head"))


@query("linked_highlights", f"""SELECT k, line, '[' || start || ',' || "end" || ',"' || kind || '"' || CASE WHEN target IS NULL OR p_partkey IS NULL THEN '' ELSE ',"' || p_brand || ':' || target || '"' END || ']' AS text FROM ({SPANS}) LEFT JOIN part ON p_partkey = target AND p_size < 25 WHERE "end" > start AND kind IN ('A', 'N')""")
def linked_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """Highlights written again with the key of their target, where it has one."""
    found = spans(spark, sf).select("k", "line", decoded(F.col("text")).alias("h")).where(F.col("h").isNotNull())
    keys = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("target"), F.concat("p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("key"))
    rows = found.join(keys, F.col("h.target") == F.col("target"), "left")
    text = F.concat(F.format_string('[%d,%d,"%s"', F.col("h.start"), F.col("h.end"), F.col("h.kind")), F.coalesce(F.concat(F.lit(',"'), "key", F.lit('"')), F.lit("")), F.lit("]"))
    return rows.select("k", "line", text.alias("text"))
