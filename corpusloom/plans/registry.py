"""Registered queries of the library and their SQL."""

from __future__ import annotations

from corpusloom.plans import text_queries, vector_queries

QUERIES: dict = text_queries.QUERIES | vector_queries.QUERIES
ORACLES: dict[str, str] = text_queries.ORACLES | vector_queries.ORACLES
