"""Every query of the library with its DuckDB SQL."""

from __future__ import annotations

from gradeloom.plans import audit_queries, gate_queries, graded_queries, numeric_queries, report_queries, source_queries, stream_queries, text_queries

_PARTS = (graded_queries, gate_queries, audit_queries, text_queries, numeric_queries, source_queries, report_queries, stream_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
