"""Problem 3: files of source_files that the project didn't write by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import file_origin
from graphloom.session import table

FOREIGN = ("third-party", "generated", "minified", "data")


def p3_origin(spark, sf_dir):
    return file_origin.classify(table(spark, sf_dir, "source_files"))


def p3_found(spark, sf_dir):
    return p3_origin(spark, sf_dir).where(F.col("origin").isin(*FOREIGN)).select("file_id")


def p3_subtrees(spark, sf_dir):
    """The files that several projects hold, with the topmost directory that they share."""
    return file_origin.copied_files(file_origin.signals(table(spark, sf_dir, "source_files")))


QUERIES = {"p3_found": p3_found, "p3_origin": p3_origin, "p3_subtrees": p3_subtrees}
ORACLE: dict[str, str] = {}
