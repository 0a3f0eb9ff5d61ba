"""SQL texts (DuckDB) that several oracles share."""

from __future__ import annotations

from siltstone.functions.text import SEPARATOR, WORD

PARTS = r"regexp_extract_all(regexp_replace(regexp_replace({s}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z][0-9]*)([0-9])([a-z])', '\1 \2 \3', 'g'), '[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+')"


def tokens(text: str) -> str:
    """A list of the text's tokens."""
    parts = PARTS.format(s="s")
    return f"""flatten(list_transform(regexp_extract_all({text}, '{WORD}'), lambda w: list_concat([lower(w)], flatten(list_transform(
      list_filter(string_split_regex(w, '{SEPARATOR}'), lambda s: s <> ''),
      lambda s: list_concat(CASE WHEN lower(s) <> lower(w) THEN [lower(s)] ELSE []::VARCHAR[] END,
                            CASE WHEN len({parts}) > 1 THEN list_transform({parts}, lambda p: lower(p)) ELSE []::VARCHAR[] END))))))"""


def singular(t: str) -> str:
    return f"CASE WHEN length({t}) >= 5 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' WHEN length({t}) >= 5 AND {t} LIKE '%es' THEN {t}[:-3] WHEN length({t}) >= 5 AND {t} LIKE '%s' THEN {t}[:-2] ELSE {t} END"


QUERIES = "SELECT item_id AS query_id, text FROM benchmark"
DOCUMENTS = "SELECT doc_id AS id, text FROM documents"
HEADS = "SELECT doc_id AS id, source || ' ' || string_split(text, chr(10))[1] AS text FROM documents"


def bm25(docs: str = DOCUMENTS, queries: str = QUERIES, limit: int = 10, name: str = "bm25") -> str:
    """Common table expressions that end in `name` (query_id, rank, id, score)."""
    n = name
    return f"""
{n}_d AS ({docs}), {n}_t AS (SELECT id, unnest({tokens("text")}) AS term FROM {n}_d),
{n}_c AS (SELECT id, term, count(*) AS tf FROM {n}_t GROUP BY id, term), {n}_l AS (SELECT id, sum(tf) AS length FROM {n}_c GROUP BY id),
{n}_s AS (SELECT count(*) AS total, CASE WHEN avg(coalesce(length, 0)) > 0 THEN avg(coalesce(length, 0)) ELSE 1 END AS mean FROM {n}_d LEFT JOIN {n}_l USING (id)),
{n}_f AS (SELECT term, count(*) AS df FROM {n}_c GROUP BY term),
{n}_q AS (SELECT DISTINCT query_id, unnest({tokens("text")}) AS term FROM ({queries})),
{n}_h AS (SELECT query_id, id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM {n}_q JOIN {n}_c USING (term) JOIN {n}_f USING (term) JOIN {n}_l USING (id), {n}_s GROUP BY query_id, id),
{n} AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {n}_h WHERE score <> 0) WHERE rank <= {limit})"""


def top(scores: str, limit: int = 10, ties: str = "id") -> str:
    return f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM ({scores})) WHERE rank <= {limit}"


UNIT = """u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS raw FROM embeddings),
n AS (SELECT id, label, CASE WHEN sqrt(list_dot_product(raw, raw)) > 0 THEN list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) ELSE raw END AS v FROM u)"""
