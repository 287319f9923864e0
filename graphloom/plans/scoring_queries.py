"""Queries of adaptive scoring over the hits of a question."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import scoring as S
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.plans.hits import HITS_SQL, hits
from graphloom.sources.graph_tables import memory_edges, memory_nodes

catalog = Catalog()

def _hits(spark, sf_dir):
    return hits(spark, sf_dir).select("id", F.col("d").alias("score"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, s AS (SELECT id AS procedure, status FROM m WHERE node_type = 'Episode'),
c AS (SELECT procedure, d + 0.3 AS c FROM s JOIN h ON h.id = procedure UNION ALL SELECT src, d + 0.9 + 0.1 FROM (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'has_facet') JOIN h ON h.id = dst)
SELECT procedure, round(min(c) + CASE WHEN coalesce(any_value(status), 'active') = 'active' THEN 0 ELSE 0.4 END, 6) AS score FROM c JOIN s USING (procedure) GROUP BY procedure"""
)
def procedure_bundles(spark, sf_dir):
    """Bundles with points of one step, episodes standing for procedures and facets for their points."""
    points = memory_edges(spark, sf_dir, "has_facet").select(F.col("src").alias("procedure"), F.col("dst").alias("point")).distinct()
    status = memory_nodes(spark, sf_dir).where("node_type = 'Episode'").select(F.col("id").alias("procedure"), "status")
    return S.procedure_bundles(points, _hits(spark, sf_dir), status)


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, x AS (SELECT DISTINCT me.src, me.dst, h.d AS node, 0.9 AS edge, row_number() OVER (ORDER BY h.d, me.src, me.dst) - 1 AS rank
FROM (SELECT DISTINCT src, dst FROM me) me JOIN h ON h.id = me.dst), w AS (SELECT *, least(greatest((1 - node) / (1 - node + 0.1 + 0.01), 0.2), 0.8) AS wn FROM x)
SELECT src, dst, round(0.6 * greatest(0, wn * node + (1 - wn) * edge - 0.05) + 0.4 * (1 - 1 / (1 + rank * 0.5)), 6) AS score FROM w WHERE rank < 50"""
)
def adaptive_edge_scores(spark, sf_dir):
    """The fifty best edges by hit, with their final scores."""
    links = memory_edges(spark, sf_dir).select("src", "dst").distinct()
    top = links.join(_hits(spark, sf_dir).select(F.col("id").alias("dst"), F.col("score").alias("node")), "dst").orderBy("node", "src", "dst").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("node", "src", "dst")) - 1)  # fifty rows
    weight = S.node_weight(1 - F.col("node"), F.lit(0.1))
    semantic = S.semantic_score(F.col("node"), F.lit(0.9), weight, F.lit(0.05))
    return ranked.select("src", "dst", F.round(S.final_score(semantic, F.col("rank"), F.lit(0.6)), 6).alias("score"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
