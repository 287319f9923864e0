"""Adaptive weights of hits, final scores, procedure bundles, and failure buckets of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.retrieval import structural_score

PROCEDURE_HOP, DIRECT_PENALTY, INACTIVE_PENALTY, EDGE_MISS = 0.1, 0.3, 0.4, 0.9


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def node_weight(node_confidence: Column, edge_confidence: Column) -> Column:
    """How much nodes count against edges, by how far the best hits of each can be trusted."""
    return clip(node_confidence / (node_confidence + edge_confidence + 0.01), 0.2, 0.8)


def semantic_score(node: Column, edge: Column, weight: Column, bonus: Column) -> Column:
    return F.greatest(F.lit(0.0), weight * node + (1 - weight) * edge - bonus)


def final_score(semantic: Column, rank: Column, share: Column) -> Column:
    """The semantic score and the structural one, in the given proportion; lower is better."""
    return share * semantic + (1 - share) * structural_score(rank)


def procedure_bundles(points: DataFrame, hits: DataFrame, status: DataFrame) -> DataFrame:
    """(procedure, score) of every procedure that a hit leads to: itself or by one of its points; one that isn't active costs more.

    ``points`` has procedure and point, ``hits`` id and score, ``status`` procedure and status.
    """
    best = hits.groupBy("id").agg(F.min("score").alias("d"))
    direct = status.select("procedure").distinct().join(best.withColumnRenamed("id", "procedure"), "procedure").select("procedure", (F.col("d") + DIRECT_PENALTY).alias("c"))
    via = points.join(best.withColumnRenamed("id", "point"), "point").select("procedure", (F.col("d") + EDGE_MISS + PROCEDURE_HOP).alias("c"))
    cost = direct.unionByName(via).groupBy("procedure").agg(F.min("c").alias("c")).join(status, "procedure")
    late = F.when(F.coalesce(F.col("status"), F.lit("active")) == "active", 0.0).otherwise(INACTIVE_PENALTY)
    return cost.select("procedure", F.round(F.col("c") + late, 6).alias("score"))


def failure_buckets(cases: DataFrame) -> DataFrame:
    """(bucket, n_cases): a case may be in several buckets.

    ``cases`` has expected and triggered (booleans), n_hits, hit_rank (null if the expected one wasn't found), injected and active.
    """
    c = F.col
    buckets = F.array_compact(
        F.array(
            F.when(c("expected") & ~c("triggered"), "missed trigger"),
            F.when(~c("expected") & c("triggered"), "false trigger"),
            F.when(c("expected") & (c("n_hits") == 0), "no hits"),
            F.when(c("expected") & (c("n_hits") > 0) & c("hit_rank").isNull(), "wrong hits"),
            F.when(c("hit_rank") > 1, "low rank"),
            F.when(c("hit_rank").isNotNull() & ~c("injected"), "not injected"),
            F.when(c("hit_rank").isNotNull() & ~c("active"), "inactive version"),
        )
    )
    return cases.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_cases"))
