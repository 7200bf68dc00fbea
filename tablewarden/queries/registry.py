"""All registered queries and oracles."""

from __future__ import annotations

from tablewarden.queries import artifacts, catalogs, copies, runs, scrubs, settings_queries, streams_queries

_MODULES = (copies, catalogs, artifacts, runs, scrubs, settings_queries, streams_queries)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
