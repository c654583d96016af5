"""All queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from shelfspark.llm import queries

QUERIES = dict(queries.QUERIES)
ORACLE = dict(queries.ORACLE)
