"""Queries over the test tables, one module a family: QUERIES by name, and ORACLES with their SQL."""

from . import matching, reading, routing, scanning, state

_MODULES = (matching, reading, state, scanning, routing)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
