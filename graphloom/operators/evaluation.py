"""Metrics of retrieval runs: hits, rates by type and overall, regressions against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(type, n, recall_at_k...) by type and, with a null type, overall. ``results`` has query_id, id and rank, ``expected`` query_id, type and id."""
    hits = expected.join(results, ["query_id", "id"], "left").groupBy("query_id", "type").agg(F.min("rank").alias("best"))
    rates = [F.round(F.avg((F.coalesce("best", F.lit(10**9)) <= k).cast("double")), 6).alias(f"recall_at_{k}") for k in ks]
    return hits.rollup("type").agg(F.count("*").alias("n"), *rates)


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, value, base, delta, regressed): worse than the baseline by more than the tolerance, in the metric's bad direction.

    Both have metric and value; a metric whose name begins with ``false`` is better when lower.
    """
    both = now.join(baseline.select("metric", F.col("value").alias("base")), "metric")
    delta = F.round(F.col("value") - F.col("base"), 6)
    worse = F.when(F.col("metric").startswith("false"), delta > tolerance).otherwise(delta < -tolerance)
    return both.select("metric", "value", "base", delta.alias("delta"), worse.alias("regressed"))
