"""The named queries over the stand-in tables, each with the SQL that says the same."""

from __future__ import annotations

from keepsake.plans import queries_ingest, queries_joins, queries_rollups, queries_search, queries_sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (queries_ingest, queries_rollups, queries_joins, queries_search, queries_sources):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
