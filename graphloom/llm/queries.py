"""Queries of the training-data operators, by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from graphloom.llm import credentials_queries, encoding_queries, file_origin_queries, function_docs_queries, leakage_queries, near_duplicates_queries, quality_queries, splitting_queries, syntax_errors_queries

_MODULES = [splitting_queries, credentials_queries, file_origin_queries, function_docs_queries, near_duplicates_queries, syntax_errors_queries, encoding_queries, leakage_queries, quality_queries]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
