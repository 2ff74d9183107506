"""The registered queries of the core library and their SQL oracles."""

from __future__ import annotations

from symbolary.plans import graph_queries, language_queries, prose_queries

FLAGSHIP = "match_topk"
_MODULES = (graph_queries, language_queries, prose_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.O.items()}
