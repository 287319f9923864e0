"""Parent-child rows to full hierarchies by pointer doubling.

Every round joins the ancestor pointers with themselves, which doubles the
distance that a pointer spans, so a tree of depth d takes log2(d) rounds. Each
round is one equi-join of the rows that aren't finished; its result is written
to the checkpoint folder, so a lost executor costs one round at most.

Defined results for odd input
-----------------------------
* An edge with a null end is ignored, as is one with an end that is missing in
  ``nodes`` (where ``nodes`` is given). Repeated edges and repeated nodes count
  once. Other columns of the input, whatever their names, are dropped.
* A node without a parent is a root: depth 0, its path is itself.
* A node with several parents, none of them below a cycle, keeps one row: its
  tree parent is the smallest parent in string order.
* A node on a cycle (a loop on itself included) or below one by any of its
  parents has no row in the hierarchy; ``cycles`` names it.
* Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_and_count, cut_lineage


def parent_links(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    *,
    src: str = "src",
    dst: str = "dst",
    node_id: str = "id",
    where: Column | None = None,
) -> DataFrame:
    """Distinct (child, parent) pairs with both ends known."""
    rows = edges if where is None else edges.where(where)
    links = rows.select(F.col(dst).alias("child"), F.col(src).alias("parent")).where(
        F.col("child").isNotNull() & F.col("parent").isNotNull()
    )
    if nodes is not None:
        known = nodes.select(F.col(node_id).alias("known_id"))
        links = links.join(known, links.child == known.known_id, "left_semi")
        links = links.join(known, links.parent == known.known_id, "left_semi")
    return links.distinct()


def cycles(links: DataFrame, *, written: bool = False) -> DataFrame:
    """(node_id, cycle_id) of every node on or below a cycle of ``links``.

    ``links`` is a table (child, parent) as ``parent_links`` returns it, ``written`` if
    it needs no computing again. After
    k rounds a node has pointers only if a walk of 2**k steps leads upwards from
    it. A round in which no node loses its last pointer leaves exactly the nodes
    that a cycle feeds. Only nodes that are themselves parents take part in the
    rounds; leaves follow their parents at the end.
    """
    links = links if written else cut_lineage(links)
    parents = links.select(F.col("parent").alias("p")).distinct()
    inner = links.join(parents, links.child == parents.p, "left_semi")
    walks, left = cut_and_count(inner.groupBy("child").agg(F.collect_set("parent").alias("ups")))
    while left:
        lower = walks.select("child", F.explode("ups").alias("mid"))
        upper = walks.select(F.col("child").alias("mid"), F.col("ups").alias("mid_ups"))
        walks, now = cut_and_count(
            lower.join(upper, "mid")
            .select("child", F.explode("mid_ups").alias("up"))
            .groupBy("child")
            .agg(F.collect_set("up").alias("ups"))
        )
        if now == left:
            break
        left = now
    fed = walks.select(F.col("child").alias("node_id"))
    named = _cycle_names(inner, fed)
    below = (
        links.join(named.withColumnRenamed("node_id", "parent"), "parent")
        .groupBy(F.col("child").alias("node_id"))
        .agg(F.min("cycle_id").alias("cycle_id"))
    )
    return named.unionByName(below).groupBy("node_id").agg(F.min("cycle_id").alias("cycle_id"))


def _cycle_names(inner: DataFrame, fed: DataFrame) -> DataFrame:
    """The smallest id on the cycle that each of the nodes ``fed`` leads up to.

    Among these nodes one parent each is enough: every one of them has a parent
    that is fed, too. ``low`` is the smallest id among the nodes from a node up
    to its pointer's end; beyond the tail that is the smallest of the cycle. The
    name found at the pointer's end is final once no node's name changes.
    """
    ups = fed.select(F.col("node_id").alias("parent"))
    jump = (
        inner.join(fed, inner.child == fed.node_id, "left_semi")
        .join(ups, "parent", "left_semi")
        .groupBy("child")
        .agg(F.min("parent").alias("up"))
        .select("child", "up", F.col("child").alias("low"), F.lit(None).cast("string").alias("cycle_id"))
    )
    jump = cut_lineage(jump)
    while True:
        upper = jump.select(F.col("child").alias("up"), F.col("up").alias("next_up"), F.col("low").alias("next_low"))
        jump, moved = cut_and_count(
            jump.join(upper, "up").select(
                "child",
                F.col("next_up").alias("up"),
                F.least("low", "next_low").alias("low"),
                F.col("next_low").alias("cycle_id"),
                (~F.col("next_low").eqNullSafe(F.col("cycle_id"))).alias("moved"),
            ),
            "moved",
        )
        if not moved:
            return jump.select(F.col("child").alias("node_id"), "cycle_id")
        jump = jump.drop("moved")


def tree(links: DataFrame, nodes: DataFrame, *, node_id: str = "id", counts: bool = False) -> DataFrame:
    """(node_id, parent_id, root_id, depth, path[, n_descendants]) of every node that no cycle feeds.

    ``path`` is the array of ids from the root to the node itself.
    """
    ids = nodes.select(F.col(node_id).alias("node_id")).where("node_id is not null").distinct()
    links = cut_lineage(links)
    fed = cycles(links, written=True)
    kept = links.join(fed, links.child == fed.node_id, "left_anti")
    parent = cut_lineage(kept.groupBy(F.col("child").alias("node_id")).agg(F.min("parent").alias("parent_id")))
    # only nodes that are parents themselves take part in the rounds; leaves follow their parents at the end
    parents = parent.select(F.col("parent_id").alias("up")).distinct()
    inner = parent.join(parents, parent.node_id == parents.up, "left_semi")
    own = parent.groupBy("parent_id").agg(F.count("*").alias("n"))
    # open rows point at an ancestor that has a parent itself; done rows at a root
    has_parent = parent.join(parents, parent.node_id == parents.up, "left_semi").select(F.col("node_id").alias("up"), F.lit(True).alias("open"))
    rows = (
        inner.join(own.select(F.col("parent_id").alias("node_id"), "n"), "node_id")
        .select("node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("tail"), "n")
        .join(has_parent, "up", "left")
        .select("node_id", "up", "tail", "n", F.coalesce("open", F.lit(False)).alias("open"))
    )
    rows, left = cut_and_count(rows, "open")
    done = rows.where("not open")
    rows = rows.where("open")
    while left:
        # rows that are done are written once and only looked up afterwards
        upper = done.unionByName(rows).select(
            F.col("node_id").alias("up"), F.col("up").alias("next_up"), F.col("tail").alias("next_tail"), F.col("open").alias("next_open")
        )
        moved = rows.join(upper, "up").select(
            "node_id", F.col("next_up").alias("up"), F.concat("next_tail", "tail").alias("tail"), "n", F.col("next_open").alias("open")
        )
        moved, left = cut_and_count(moved, "open")
        done = done.unionByName(moved.where("not open"))
        rows = moved.where("open")
    above = done.select(F.col("node_id").alias("parent_id"), F.col("up").alias("root_id"), F.concat(F.array("up"), "tail").alias("above"))
    if counts:
        # each descendant is the child of one node of the subtree, so the children of all its nodes are summed up
        upwards = F.concat(F.array("up"), F.slice("tail", 1, F.size("tail") - 1))
        each = done.select(F.explode(upwards).alias("node_id"), "n").unionByName(own.select(F.col("parent_id").alias("node_id"), "n"))
        below = cut_lineage(each.groupBy("node_id").agg(F.sum("n").alias("n_descendants")))
        # joined before the paths are, so that the rows are narrow
        parent = parent.join(below, "node_id", "left")
    # a parent without a row of its own is a root
    names = ["node_id", "parent_id", "root_id", "depth", "path", *(["n_descendants"] if counts else [])]
    inside = parent.join(above, "parent_id", "left").withColumns(
        {
            "root_id": F.coalesce("root_id", "parent_id"),
            "path": F.concat(F.coalesce("above", F.array("parent_id")), F.array("node_id")),
        }
    )
    roots = ids.join(links.select(F.col("child").alias("node_id")), "node_id", "left_anti")
    if counts:
        roots = roots.join(below, "node_id", "left")
    roots = roots.withColumns({"parent_id": F.lit(None).cast("string"), "root_id": F.col("node_id"), "path": F.array("node_id")})
    rows = roots.select(*(n for n in names if n != "depth")).unionByName(inside.select(*(n for n in names if n != "depth")))
    rows = rows.withColumn("depth", F.size("path") - 1)
    return (rows.withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0))) if counts else rows).select(*names)


def descendants(tree_rows: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node and each of its proper ancestors."""
    return tree_rows.select("node_id", "depth", F.posexplode("path").alias("level", "ancestor_id")).where(
        "level < depth"
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("level")).alias("distance"))
