"""Every query of the library outside the llm subpackage."""

from __future__ import annotations

from siltstone.plans import assessment, definitions, facade, graphs, ingest, library, modules, ranking, records, replaced, scoped, search, streams, structure, training  # noqa: F401
from siltstone.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
