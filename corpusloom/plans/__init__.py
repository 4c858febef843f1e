"""Registered queries of the library."""

from __future__ import annotations

from corpusloom.plans.registry import ORACLE_SQL, QUERIES, Query


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of all modules of this package."""
    from corpusloom.plans import answer_queries, catalog_queries, retrieval_queries, source_queries, statute_queries, structure_queries, text_queries, window_queries  # noqa: F401

    return QUERIES, ORACLE_SQL
