"""Problem 7: files of source_files that aren't valid in their language."""

from __future__ import annotations

from graphloom.llm import syntax_errors
from graphloom.session import table


def p7_found(spark, sf_dir):
    return syntax_errors.invalid_files(table(spark, sf_dir, "source_files"))


def p7_rates(spark, sf_dir):
    return syntax_errors.error_rates(table(spark, sf_dir, "source_files"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
ORACLE: dict[str, str] = {}
