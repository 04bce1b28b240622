"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from kinosift.plans import evaluation_queries, file_queries, scoring_queries, sequence_queries, source_queries, text_queries

_MODULES = (scoring_queries, sequence_queries, text_queries, source_queries, evaluation_queries, file_queries)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
