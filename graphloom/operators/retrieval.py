"""Lexical, vector and hybrid ranking, and the scores of bundles in the memory graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V

EDGE_MISS, HOP, DIRECT_PENALTY = 0.9, 0.05, 0.3


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25(documents: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document with a positive score.

    ``documents`` has doc_id and text, ``queries`` query_id and text. Terms that a
    query repeats count repeatedly; documents without terms don't count. Only
    postings of query terms are shuffled: the terms of the queries, a bounded set,
    are semi-joined before anything is grouped.
    """
    words = documents.select("doc_id", T.content_tokens(F.col("text")).alias("words")).where("size(words) > 0")
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    asked = queries.select("query_id", F.explode(T.content_tokens(F.col("text"))).alias("term"))
    terms = asked.select("term").distinct()
    posting = (
        words.select("doc_id", F.size("words").alias("len"), F.explode("words").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("doc_id", "len", "term")
        .agg(F.count("*").alias("tf"))
    )
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(size).select(  # one row of totals
        "term", "mean", F.greatest(F.lit(1e-5), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf")
    )
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return (
        asked.join(idf, "term").join(posting, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    )


def jaccard(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) by the sets of content words; only pairs that share a word."""
    d = documents.select("doc_id", F.array_distinct(T.content_tokens(F.col("text"))).alias("words"))
    q = queries.select("query_id", F.array_distinct(T.content_tokens(F.col("text"))).alias("words"))
    dt = d.select("doc_id", F.size("words").alias("nd"), F.explode("words").alias("term"))
    qt = q.select("query_id", F.size("words").alias("nq"), F.explode("words").alias("term"))
    return (
        qt.join(dt, "term")
        .groupBy("query_id", "doc_id", "nd", "nq")
        .agg(F.count("*").alias("both"))
        .select("query_id", "doc_id", (F.col("both") / (F.col("nd") + F.col("nq") - F.col("both"))).alias("score"))
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_numbers: int = 8_000_000) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest vectors of each query, exactly.

    The queries are a stated set that is held against all rows, in blocks of about
    ``block_numbers`` numbers in all (64 MB), each of which is broadcast; only k rows
    a query leave a partition.
    """
    size = queries.agg(F.sum(F.size("query_vec") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_numbers))
    parts = []
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        pairs = vectors.join(F.broadcast(some), vectors.vec_id != some.query_id)
        parts.append(
            pairs.select("query_id", "vec_id", V.cosine_distance(F.col("embedding"), F.col("query_vec")).alias("distance"))
        )
    scored = reduce(DataFrame.unionByName, parts)
    return top_k(scored, ["query_id"], [F.col("distance"), F.col("vec_id")], k)


def rrf(dense: DataFrame, sparse: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (keys, rank): distances in [0, 1], lower is better."""
    both = dense.select(*keys, F.col("rank").alias("rd")).join(sparse.select(*keys, F.col("rank").alias("rs")), keys, "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", part("rd") + part("rs"))
    w = Window.partitionBy(keys[0])
    low, high = F.min("rrf").over(w), F.max("rrf").over(w)
    return scored.withColumn("distance", F.when(high == low, 0.0).otherwise(1 - (F.col("rrf") - low) / (high - low)))


def minmax(rows: DataFrame, group: str, score: str) -> DataFrame:
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("normal", F.when(high == low, 0.0).otherwise((F.col(score) - low) / (high - low)))


def episode_bundles(edges: DataFrame, hits: DataFrame, edge_hits: DataFrame | None = None) -> DataFrame:
    """(episode, score, path) of every episode that a hit leads to, by its cheapest way.

    ``edges`` has src, dst, relationship_name and edge_text (has_facet,
    has_point, involves_entity), ``hits`` has id and score, lower is better;
    ``edge_hits`` has text and score. Ways: the episode itself, a facet, a point of
    a facet, an entity of a facet, an entity. Ties go to the first in this order.
    """
    e = edges
    if edge_hits is not None:
        known = edge_hits.groupBy(F.col("text").alias("edge_text")).agg(F.min("score").alias("cost"))
        e = e.join(known, "edge_text", "left")
    else:
        e = e.withColumn("cost", F.lit(None).cast("double"))
    e = e.withColumn("cost", F.coalesce("cost", F.lit(EDGE_MISS)))
    best = hits.groupBy("id").agg(F.min("score").alias("d"))

    def typed(name: str, a: str, b: str) -> DataFrame:
        return e.where(F.col("relationship_name") == name).groupBy(F.col("src").alias(a), F.col("dst").alias(b)).agg(F.min("cost").alias("cost"))

    facet_of, point_of = typed("has_facet", "episode", "facet"), typed("has_point", "facet", "point")
    entity_of = typed("involves_entity", "holder", "entity")
    own = best.select(F.col("id").alias("facet"), F.col("d").alias("own"))
    by_point = point_of.join(best.select(F.col("id").alias("point"), "d"), "point").select("facet", (F.col("d") + F.col("cost") + HOP).alias("c"))
    by_entity = entity_of.join(best.select(F.col("id").alias("entity"), "d"), "entity")
    facet_entity = by_entity.select(F.col("holder").alias("facet"), (F.col("d") + F.col("cost") + HOP).alias("c"))
    ways = (
        own.select("facet", F.col("own").alias("c"), F.lit(1).alias("k"))
        .unionByName(by_point.withColumn("k", F.lit(2)))
        .unionByName(facet_entity.withColumn("k", F.lit(3)))
    )
    facet_cost = ways.groupBy("facet").agg(F.min(F.struct("c", "k")).alias("w")).join(own, "facet", "left")
    strong = F.col("own")
    edge = F.when(strong < 0.1, 0.1).when(strong < 0.2, F.col("cost") * 0.3).otherwise(F.col("cost"))
    hop = F.when(strong < 0.1, 0.05).when(strong < 0.2, HOP * 0.3).otherwise(HOP)
    via_facet = facet_of.join(facet_cost, "facet").select("episode", (F.col("w.c") + edge + hop).alias("c"), F.col("w.k").alias("k"))
    direct = facet_of.select("episode").union(entity_of.select("holder")).distinct().join(best.select(F.col("id").alias("episode"), "d"), "episode")
    direct = direct.select("episode", (F.col("d") + DIRECT_PENALTY).alias("c"), F.lit(0).alias("k"))
    episodes = facet_of.select("episode").distinct()
    via_entity = by_entity.join(episodes, by_entity.holder == episodes.episode, "left_semi").select(
        F.col("holder").alias("episode"), (F.col("d") + F.col("cost") + HOP).alias("c"), F.lit(4).alias("k")
    )
    names = F.array(*map(F.lit, ["direct_episode", "facet", "point", "facet_entity", "entity"]))
    chosen = direct.unionByName(via_facet).unionByName(via_entity).groupBy("episode").agg(F.min(F.struct("c", "k")).alias("w"))
    return chosen.select("episode", F.round("w.c", 6).alias("score"), F.get(names, F.col("w.k")).alias("path"))


def time_overlap(c0: Column, c1: Column, q0: Column, q1: Column) -> Column:
    """The share of the shorter range that two ranges have in common; 0 if they only touch."""
    common = F.least(c1, q1) - F.greatest(c0, q0)
    shorter = F.least(c1 - c0, q1 - q0)
    return F.when((common <= 0) | (shorter <= 0), 0.0).otherwise(F.least(F.lit(1.0), common / shorter))


def time_bonus(c0: Column, c1: Column, confidence: Column, created: Column, q0: Column, q1: Column, q_conf: float, most: float = 0.06) -> Column:
    """By the time that a text mentions; without one, half by when it was made."""
    mentioned = time_overlap(c0, c1, q0, q1) * F.coalesce(confidence, F.lit(0.7))
    made = F.when((created >= q0) & (created <= q1), 0.5).otherwise(0.0)
    return F.least(F.lit(most), F.when(c0.isNotNull() & c1.isNotNull(), mentioned).otherwise(made) * q_conf * most)


def distance_factor(ratio: Column) -> Column:
    return (
        F.when(ratio <= 0.5, 1.0)
        .when(ratio <= 1.0, 1.0 - (ratio - 0.5))
        .when(ratio <= 1.5, 0.5 - (ratio - 1.0) * 0.4)
        .otherwise(F.greatest(F.lit(0.1), 0.3 - (ratio - 1.5) * 0.2))
    )


def gap_factor(gap: Column) -> Column:
    return F.when(gap < 0.01, 0.2).when(gap <= 0.05, 0.2 + (gap - 0.01) / 0.04 * 0.4).when(gap < 0.15, 0.6 + (gap - 0.05) / 0.1 * 0.4).otherwise(1.0)


def structural_score(rank: Column, decay: float = 0.5) -> Column:
    return 1 - 1 / (1 + rank * decay)
