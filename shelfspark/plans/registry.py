"""All queries of the core and the SQL they are compared with."""

from __future__ import annotations

from shelfspark.plans import catalog, functions, general, pipeline, retrieval, review

_MODULES = [general, functions, catalog, retrieval, pipeline, review]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "p1_found"
