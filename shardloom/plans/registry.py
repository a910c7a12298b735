"""All queries of the core with their SQL."""

from __future__ import annotations

from shardloom.plans import cache_queries, change_queries, cluster_queries, retrieval_queries, store_queries, stream_queries

_MODULES = (retrieval_queries, store_queries, cache_queries, cluster_queries, change_queries, stream_queries)
FLAGSHIP = "retrieve"
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
