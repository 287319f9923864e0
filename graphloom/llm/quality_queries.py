"""Problem 10: statistics of documents, and those that aren't natural prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import quality
from graphloom.session import table


def p10_statistics(spark, sf_dir):
    return quality.text_statistics(table(spark, sf_dir, "documents"))


def p10_found(spark, sf_dir):
    return p10_statistics(spark, sf_dir).where(~F.col("quality").isin("prose", "blank")).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
ORACLE: dict[str, str] = {}
