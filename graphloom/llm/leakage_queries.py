"""Problem 9: eval_items in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import leakage
from graphloom.session import table


def _leaks(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark, sf_dir):
    """How far each test item leaked: the texts that hold it and the largest share of it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "item_kind").distinct()
    counts = _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("n_documents"), F.round(F.max("coverage"), 6).alias("max_coverage")
    )
    return items.join(counts, "item_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
ORACLE: dict[str, str] = {}
