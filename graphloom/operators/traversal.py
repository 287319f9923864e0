"""Bounded graph traversal: breadth-first reach, paths, slices, components' neighbourhoods.

``edges`` are tables (src, dst[, edge_type]); ``seeds`` a table with one column
``id``. Each round is an equi-join of the frontier with the edges followed by an
anti-join with what was reached before; the reached set is cut from its lineage
every round, so a lost executor costs one round. A node that is reached in a
round by several edges keeps the smallest parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_and_count, cut_lineage


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst) to follow: ``out`` along the edges, ``in`` against them, ``both``."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """(seed, id, depth, parent) of every node within ``max_depth`` steps of a seed, by the shortest way.

    A seed itself has depth 0 and no parent.
    """
    steps = cut_lineage(directed(edges, direction))
    start = seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct()
    seen = cut_lineage(
        start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    )
    frontier = seen
    for depth in range(1, max_depth + 1):
        moved = (
            frontier.select("seed", F.col("id").alias("src"))
            .join(steps, "src")
            .groupBy("seed", F.col("dst").alias("id"))
            .agg(F.min("src").alias("parent"))
            .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
            .select("seed", "id", F.lit(depth).alias("depth"), "parent")
        )
        frontier, reached = cut_and_count(moved)
        if not reached:
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 10, direction: str = "both") -> DataFrame:
    """(pos, id) of one shortest path, by smallest parents; no row if there is none."""
    spark = edges.sparkSession
    seen = cut_lineage(reach(edges, spark.createDataFrame([(start,)], "id string"), max_depth, direction))
    here = seen.where(F.col("id") == end).select("id", "depth", "parent")
    path = here
    for _ in range(max_depth):
        here = seen.join(here.select(F.col("parent").alias("id")), "id", "left_semi").select("id", "depth", "parent")
        path = path.unionByName(here)
    return path.select(F.col("depth").alias("pos"), "id").distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """The nodes (id, depth) within some hops of any seed, and all edges between them."""
    nodes = cut_lineage(reach(edges, seeds, hops, direction).groupBy("id").agg(F.min("depth").alias("depth")))
    inner = edges
    for end in ("src", "dst"):
        inner = inner.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, inner


def ancestors(tree_edges: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """(id, ancestor, distance) up a tree of (src = parent, dst = child); the node itself has distance 0."""
    up = cut_lineage(tree_edges.select(F.col("dst").alias("child"), F.col("src").alias("above")).distinct())
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    out = level
    for k in range(1, max_depth + 1):
        level, reached = cut_and_count(
            level.join(up, level.ancestor == up.child).select("id", F.col("above").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        )
        if not reached:
            break
        out = out.unionByName(level)
    return out.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a way of one step or more; each round doubles the length of the ways."""
    new, left = cut_and_count(edges.select("src", "dst").distinct())
    pairs = new
    while left:
        # only pairs of the last round can give further ones
        ahead = new.select("src", F.col("dst").alias("mid")).join(pairs.select(F.col("src").alias("mid"), "dst"), "mid")
        behind = pairs.select("src", F.col("dst").alias("mid")).join(new.select(F.col("src").alias("mid"), "dst"), "mid")
        longer = ahead.select("src", "dst").unionByName(behind.select("src", "dst")).distinct()
        new, left = cut_and_count(longer.join(pairs, ["src", "dst"], "left_anti"))
        pairs = pairs.unionByName(new)
    return pairs


def triangles(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles) over the undirected graph without loops; each link is kept at its end of lower degree."""
    both = directed(edges, "both").where("src <> dst")
    degree = cut_lineage(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
    d = degree.select(F.col("id").alias("src"), F.col("degree").alias("ds"))
    e = degree.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    ranked = cut_lineage(
        both.join(d, "src").join(e, "dst").where("ds < dd or (ds = dd and src < dst)").select("src", "dst")
    )
    wedge = ranked.select("src", F.col("dst").alias("a")).join(ranked.select("src", F.col("dst").alias("b")), "src").where("a <> b")
    closed = wedge.join(ranked.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"])
    corners = closed.select(F.explode(F.array("src", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return degree.join(corners, "id", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): each node takes the most frequent label around it, then the smallest; labels begin as ids."""
    both = cut_lineage(directed(edges, "both").where("src <> dst"))
    labels = cut_lineage(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("k"), "community")).alias("b"))
        labels = cut_lineage(best.select(F.col("src").alias("id"), "b.community"))
    return labels
