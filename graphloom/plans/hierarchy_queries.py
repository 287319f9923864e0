"""Queries over the PARENT_OF hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy
from graphloom.session import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.parent_links(
        table(spark, sf_dir, "edges"),
        table(spark, sf_dir, "nodes"),
        where=F.upper(F.trim("edge_type")) == "PARENT_OF",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycles(_links(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    return hierarchy.tree(_links(spark, sf_dir), table(spark, sf_dir, "nodes"), counts=counts)


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, counts=True).withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}

_LINKS_SQL = """
ids AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL),
links AS (
  SELECT DISTINCT e.dst AS child, e.src AS parent FROM edges e
  JOIN ids a ON a.id = e.src JOIN ids b ON b.id = e.dst
  WHERE upper(trim(e.edge_type)) = 'PARENT_OF'),
reach AS (
  SELECT child AS node, parent AS anc FROM links
  UNION
  SELECT r.node, l.parent FROM reach r JOIN links l ON l.child = r.anc),
on_cycle AS (SELECT node FROM reach WHERE node = anc),
cycle_name AS (
  SELECT r.node, min(r.anc) AS cycle_id FROM reach r
  JOIN on_cycle c ON c.node = r.node JOIN on_cycle d ON d.node = r.anc
  JOIN reach back ON back.node = r.anc AND back.anc = r.node GROUP BY r.node),
fed AS (
  SELECT node AS node_id, cycle_id FROM cycle_name
  UNION
  SELECT r.node, n.cycle_id FROM reach r JOIN cycle_name n ON n.node = r.anc)
"""

_TREE_SQL = (
    "WITH RECURSIVE "
    + _LINKS_SQL
    + """,
tree_parent AS (
  SELECT child, min(parent) AS parent FROM links
  WHERE child NOT IN (SELECT node_id FROM fed) GROUP BY child),
tree AS (
  SELECT id AS node_id, CAST(NULL AS VARCHAR) AS parent_id, id AS root_id, 0 AS depth, id AS path
  FROM ids WHERE id NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT p.child, p.parent, t.root_id, t.depth + 1, t.path || '/' || p.child
  FROM tree t JOIN tree_parent p ON p.parent = t.node_id),
below AS (
  SELECT node_id AS ancestor_id, node_id, 0 AS distance FROM tree
  UNION ALL
  SELECT b.ancestor_id, p.child, b.distance + 1 FROM below b JOIN tree_parent p ON p.parent = b.node_id)
"""
)

ORACLE = {
    "p5_found": "WITH RECURSIVE " + _LINKS_SQL + "SELECT DISTINCT node_id, cycle_id FROM fed",
    "p5_hierarchy": _TREE_SQL
    + """SELECT t.*, coalesce(n, 0) AS n_descendants FROM tree t
LEFT JOIN (SELECT ancestor_id, count(*) AS n FROM below WHERE distance > 0 GROUP BY 1) b ON b.ancestor_id = t.node_id""",
    "p5_descendants": _TREE_SQL + "SELECT ancestor_id, node_id, distance FROM below WHERE distance > 0",
}
