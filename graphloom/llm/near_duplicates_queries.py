"""Problem 6: function records that are edited copies of each other."""

from __future__ import annotations

from graphloom.llm import near_duplicates
from graphloom.llm.records import functions


def p6_found(spark, sf_dir):
    return near_duplicates.similar_pairs(functions(spark, sf_dir))


def p6_groups(spark, sf_dir):
    return near_duplicates.similar_groups(functions(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
ORACLE: dict[str, str] = {}
