"""The engine's queries by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from lodestrata.queries.registry import QUERIES, SQL

from lodestrata.queries import aggregates, changes, joins, live, nested, predicates, references, scans, search, streams, values, writes  # noqa: F401,I001 - each registers its queries

__all__ = ["QUERIES", "SQL"]
