"""All queries and their oracles."""

from __future__ import annotations

from . import crm_queries, data_queries, dataset_queries, index_queries, sql_queries, state_queries, surface_queries, text_queries

_MODULES = (crm_queries, text_queries, data_queries, dataset_queries, surface_queries, state_queries, index_queries, sql_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "flagship_region_closure"
