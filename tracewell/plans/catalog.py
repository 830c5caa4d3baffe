"""Registry of the engine's queries and of the SQL each is checked against."""

from __future__ import annotations

from tracewell.plans import evidence_queries, keyword_queries, planning_queries, provider_queries, ranking_queries, selection_queries, source_queries, text_queries

QUERIES = {}
ORACLES = {}
for _module in (evidence_queries, keyword_queries, ranking_queries, planning_queries, text_queries, source_queries, selection_queries, provider_queries):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
