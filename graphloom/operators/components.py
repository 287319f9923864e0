"""Connected components by alternating large-star and small-star rounds.

The rounds end after about log(diameter) steps; each is one grouping of the
remaining links. Links are numbers of rows, never collected into one task: the
stars use the minimum of a group, not its list of members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that occurs in a link of two nodes.

    ``component`` is the smallest node of the component. Null ends and loops are
    ignored, except that the node of a loop is its own component.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = cut_lineage(pairs.distinct())
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    stars = pairs.where("u <> v")
    while True:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        # large star: every larger neighbour goes to the smallest node around
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        down = large.where("u <> v")
        floor = down.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            down.join(floor, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = cut_lineage(small)
        settled = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        if settled and new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count() == 0:
            break
        stars = new
    return nodes.join(new.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select(
        "node", F.coalesce("low", "node").alias("component")
    )
