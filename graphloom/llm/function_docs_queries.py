"""Problem 4: function records with a telling documentation."""

from __future__ import annotations

from graphloom.llm import function_docs
from graphloom.llm.records import functions


def p4_found(spark, sf_dir):
    return function_docs.function_pairs(functions(spark, sf_dir), with_source=False).select("node_id")


def p4_pairs(spark, sf_dir):
    return function_docs.function_pairs(functions(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
ORACLE: dict[str, str] = {}
