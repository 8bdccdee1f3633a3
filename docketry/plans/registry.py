"""All queries of the core, by name."""

from __future__ import annotations

from docketry.plans import carried, checks, general, graph, text

_MODULES = (general, text, graph, checks, carried)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
