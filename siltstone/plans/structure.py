"""Queries on the structure of texts: lines, blocks, sentences, search in lines, windows, links, spans, multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import blocks
from siltstone.plans import sql
from siltstone.plans.registry import query
from siltstone.plans.search import documents
from siltstone.sources.tables import table

LINES = r"""l AS (SELECT doc_id AS id, CAST(i AS INTEGER) AS line, regexp_replace(x[i], '\r$', '') AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM documents WHERE text <> '') d,
 LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i))"""


@query("line_counts", f"WITH {LINES} SELECT id, count(*) AS lines, max(length(content)) AS longest FROM l GROUP BY id")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.numbered_lines(documents(spark, sf)).groupBy("id").agg(F.count("*").alias("lines"), F.max(F.length("content")).alias("longest"))


@query(
    "line_blocks",
    f"""WITH {LINES}, b AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^(The|Of|En|De|Le) ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS block FROM l)
 SELECT id, CAST(block AS BIGINT) AS block, min(line) AS first, coalesce(max(line) FILTER (WHERE trim(content) <> ''), min(line)) AS last FROM b WHERE block > 0 GROUP BY id, block""",
)
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.line_blocks(blocks.numbered_lines(documents(spark, sf)), F.col("content").rlike("^(The|Of|En|De|Le) "))


@query("first_sentence", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?s)^.*?[.!?](\s|$)') THEN regexp_extract(text, '(?s)^(.*?[.!?])(\s|$)', 1) ELSE text END AS summary FROM conversations")
def first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.first_sentence(F.col("text")).alias("summary"))


PATTERN = "(?i)\\bthan"


@query("grep_lines", f"WITH {LINES} SELECT id, line, content FROM l WHERE regexp_matches(content, '{PATTERN}')")
def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.grep(documents(spark, sf), PATTERN)


@query("grep_counts", f"WITH {LINES} SELECT id, count(*) AS n FROM l WHERE regexp_matches(content, '{PATTERN}') GROUP BY id")
def grep_counts(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.grep(documents(spark, sf), PATTERN).groupBy("id").agg(F.count("*").alias("n"))


@query(
    "grep_context",
    f"""WITH {LINES}, h AS (SELECT *, regexp_matches(content, '{PATTERN}') AS hit FROM l),
 n AS (SELECT *, max(hit::INT) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h), s AS (SELECT * FROM n WHERE near = 1),
 g AS (SELECT *, CASE WHEN line - lag(line, 1, -1) OVER (PARTITION BY id ORDER BY line) > 1 THEN 1 ELSE 0 END AS gap FROM s)
 SELECT id, line, hit, CAST(sum(gap) OVER (PARTITION BY id ORDER BY line) AS BIGINT) AS island FROM g""",
)
def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.grep_context(documents(spark, sf), PATTERN, 1, 2)


#: A line's last word with what opens the next line.
ACROSS = r"[a-z]+\.\n[A-Z][a-z]+ [a-z]+"
SPANNED = f"""p AS (SELECT doc_id AS id, text, string_split_regex(text, '{ACROSS}') AS x, regexp_extract_all(text, '{ACROSS}') AS y FROM documents WHERE regexp_matches(text, '{ACROSS}')),
 n AS (SELECT id, x, y, unnest(range(1, len(y) + 1)) AS i FROM p),
 m AS (SELECT id, array_to_string(list_concat(x[1:i], y[1:i - 1]), '') AS b, y[i] AS h FROM n),
 s AS (SELECT id, length(b) AS "start", length(b) + length(h) AS "end", 1 + length(b) - length(replace(b, chr(10), '')) AS "first" FROM m)"""


@query("grep_across_lines", f'WITH {SPANNED} SELECT id, "start", "end", "first", "first" + 1 AS "last" FROM s')
def grep_across_lines(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.match_spans(documents(spark, sf), ACROSS)


@query(
    "grep_across_context",
    f"""WITH {SPANNED}, {LINES}, h AS (SELECT DISTINCT id, "first" + d AS line FROM s, (VALUES (0), (1)) v(d)),
 c AS (SELECT DISTINCT l.id, l.line, l.content FROM l JOIN h ON l.id = h.id AND l.line BETWEEN h.line - 1 AND h.line + 1),
 g AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY id ORDER BY line) > 1 THEN 1 ELSE 0 END AS gap FROM c)
 SELECT g.id, CAST(g.line AS BIGINT) AS line, h.line IS NOT NULL AS hit, CAST(sum(gap) OVER (PARTITION BY g.id ORDER BY g.line) AS BIGINT) AS island, content FROM g LEFT JOIN h ON h.id = g.id AND h.line = g.line""",
)
def grep_across_context(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.grep_spans(documents(spark, sf), ACROSS, 1, 1)


@query("file_range", f"WITH {LINES} SELECT id, line, content FROM l WHERE line BETWEEN 2 AND 4")
def file_range(spark: SparkSession, sf: str) -> DataFrame:
    part = F.slice(T.lines(F.col("text")), 2, 3)
    return documents(spark, sf).select("id", F.posexplode(part).alias("at", "content")).select("id", (F.col("at") + 2).alias("line"), "content")


@query(
    "import_usage",
    r"""SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages) GROUP BY target""",
)
def import_usage(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    per_page = links.groupBy("target", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("target").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(
    "missing_targets",
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS target FROM part) SELECT target FROM t WHERE target NOT IN (SELECT target FROM w)""",
)
def missing_targets(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("target")).distinct()
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("target"))
    return links.join(words, "target", "left_anti")


@query(
    "context_windows",
    """WITH r AS (SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, length(text) + 1 AS n FROM conversations),
 w AS (SELECT DISTINCT id, place // 4 AS w FROM r), d AS (SELECT r.*, w.w, CASE WHEN place // 4 = w.w THEN 'target' WHEN place < w.w * 4 AND place >= w.w * 4 - 4 THEN 'before' WHEN place >= w.w * 4 + 4 AND place < w.w * 4 + 6 THEN 'after' END AS role FROM r JOIN w USING (id)),
 k AS (SELECT *, sum(n) OVER (PARTITION BY id, w, role ORDER BY CASE WHEN role = 'before' THEN -place ELSE place END) AS run FROM d WHERE role IS NOT NULL)
 SELECT id, CAST(w AS INTEGER) AS "window", count(*) FILTER (WHERE role = 'target') AS target, count(*) FILTER (WHERE role = 'before') AS before, count(*) FILTER (WHERE role = 'after') AS after, min(place) AS first, max(place) AS last
 FROM k WHERE role = 'target' OR run <= 600 GROUP BY id, w HAVING count(*) FILTER (WHERE role = 'target') > 0""",
)
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return blocks.windows(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), place.alias("place"), "text"), 4, 4, 2, 600)


NAMES = "SELECT DISTINCT regexp_replace(array_to_string(string_split(trim(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/'), '/'), '.'), '\\.html$', '') AS name FROM pages"


@query(
    "parent_children",
    f"""WITH s AS ({NAMES}), n AS (SELECT name FROM s UNION SELECT string_split(name, '.')[1] FROM s WHERE name LIKE '%.%'),
 p AS (SELECT c.name, q.name AS parent FROM n c LEFT JOIN n q ON q.name = CASE WHEN c.name LIKE '%.%' THEN regexp_replace(c.name, '\\.[^.]*$', '') END)
 SELECT parent, count(*) AS children, string_agg(name, ' ' ORDER BY name) AS names FROM p WHERE parent IS NOT NULL GROUP BY parent""",
)
def parent_children(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    name = F.regexp_replace(F.replace(F.trim(path, F.lit("/")), F.lit("/"), F.lit(".")), r"\.html$", "")
    some = table(spark, sf, "pages").select(name.alias("name")).distinct()
    every = some.union(some.where(F.col("name").contains(".")).select(F.element_at(F.split("name", "[.]"), 1))).distinct()
    rows = every.withColumn("parent", T.parent_name(F.col("name"))).join(every.select(F.col("name").alias("parent")), "parent")
    return rows.groupBy("parent").agg(F.count("*").alias("children"), F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@query(
    "span_slices",
    """SELECT doc_id, list_sum(list_transform(x[2:4], lambda s: length(s)))::BIGINT AS middle, length(x[1]) AS first, len(list_distinct(list_transform(x, lambda s: length(s)))) AS lengths
 FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) WHERE len(x) >= 4""",
)
def span_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("x")).where(F.size("x") >= 4)
    sizes = F.transform("x", lambda s: F.length(s))
    middle = F.aggregate(F.slice(sizes, 2, 3), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", middle.alias("middle"), F.get(sizes, F.lit(0)).alias("first"), F.size(F.array_distinct(sizes)).alias("lengths"))


TURNS = f"SELECT conv_id, turn, {sql.tokens('text')} AS t FROM conversations"


@query(
    "multiset_overlap",
    f"""WITH c AS (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest(t) AS term FROM ({TURNS})) GROUP BY ALL),
 k AS (SELECT conv_id, turn FROM conversations), p AS (SELECT a.conv_id, a.turn FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 x AS (SELECT p.conv_id, p.turn, term, n AS l, 0 AS r FROM p JOIN c USING (conv_id, turn) UNION ALL SELECT p.conv_id, p.turn, term, 0, n FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1),
 y AS (SELECT conv_id, turn, term, max(l) AS l, max(r) AS r FROM x GROUP BY ALL)
 SELECT conv_id, turn, CAST(sum(least(l, r)) AS BIGINT) AS shared, CAST(sum(greatest(l, r)) AS BIGINT) AS whole, round(sum(least(l, r))::DOUBLE / sum(greatest(l, r)), 6) AS overlap FROM y GROUP BY conv_id, turn""",
)
def multiset_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset intersection by union of the tokens of consecutive turns; each turn's counts serve as left and as right side."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    c = turns.select("conv_id", "turn", F.explode("t").alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))
    k = turns.select("conv_id", "turn")
    pairs = k.join(k.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    left = c.select("conv_id", "turn", "term", F.col("n").alias("l"), F.lit(0).alias("r"))
    right = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "term", F.lit(0).alias("l"), F.col("n").alias("r"))
    both = left.unionByName(right).join(pairs, ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn", "term").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = both.groupBy("conv_id", "turn").agg(F.sum(F.least("l", "r")).alias("shared"), F.sum(F.greatest("l", "r")).alias("whole"))
    return found.withColumn("overlap", F.round(F.col("shared") / F.col("whole"), 6))


@query(
    "set_difference_both_ways",
    f"""WITH s AS (SELECT conv_id, turn, list_distinct(t) AS t FROM ({TURNS})) SELECT a.conv_id, a.turn, len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS gone, len(list_filter(b.t, lambda x: NOT list_contains(a.t, x))) AS come
 FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def set_difference_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("t", "u")).alias("gone"), F.size(F.array_except("u", "t")).alias("come"))


@query(
    "corpus_text",
    """SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place, sha256('===== ' || source || '/' || doc_id || ' =====' || chr(10) || text) AS digest FROM documents""",
)
def corpus_text(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as text blocks with headers, in source order, each by its digest."""
    block = F.concat(F.lit("===== "), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(" =====\n"), F.col("text"))
    rows = table(spark, sf, "documents").select("source", "doc_id", F.sha2(block, 256).alias("digest"))
    return rows.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), "digest")
