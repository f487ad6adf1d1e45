"""All registered queries and their SQL."""

from __future__ import annotations

from clicklog.plans import catalog, parameter_queries

QUERIES = catalog.QUERIES | parameter_queries.QUERIES
ORACLES = catalog.ORACLES | parameter_queries.ORACLES
