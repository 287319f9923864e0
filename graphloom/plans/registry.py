"""All queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from graphloom.plans import assembly_queries, code_queries, construction_queries, detail_queries, extended_queries, flow_queries, graph_queries, hierarchy_queries, memory_queries, retrieval_queries, rule_queries, scoring_queries, table_queries, upkeep_queries

_MODULES = [hierarchy_queries, graph_queries, retrieval_queries, memory_queries, table_queries, code_queries, extended_queries, scoring_queries, rule_queries, construction_queries, flow_queries, upkeep_queries, assembly_queries, detail_queries]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in _MODULES:
    for _name, _query in _module.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"two queries are called {_name}")
        QUERIES[_name] = _query
    ORACLE.update(_module.ORACLE)
