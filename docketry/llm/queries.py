"""All queries of this subpackage, by name."""

from __future__ import annotations

from docketry.llm import page_queries, sentence_queries, text_queries, unit_queries, value_queries

_MODULES = (unit_queries, page_queries, value_queries, sentence_queries, text_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
