"""All queries of the engine but those of the llm subpackage."""

from __future__ import annotations

from . import catalog, graph_queries, lookup_queries, module_queries, retrieval_queries, search_queries, text_queries  # noqa: F401  the modules fill the catalogue


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
