"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import corpus_queries, embedding_queries, search_queries, selection_queries, source_queries

QUERIES = embedding_queries.QUERIES | corpus_queries.QUERIES | selection_queries.QUERIES | search_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = embedding_queries.ORACLE_SQL | corpus_queries.ORACLE_SQL | selection_queries.ORACLE_SQL | search_queries.ORACLE_SQL | source_queries.ORACLE_SQL
