"""The tables of the code graph and of the memory graph, cleaned on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import table

#: The edge types of the code graph.
EDGE_TYPES = (
    "PARENT_OF FLOWS_TO REACHES CALLS CONTAINS DEPENDS_ON IMPLEMENTS_CONCEPT IMPLEMENTS TESTS IMPLEMENTED_BY MEMBER_OF".split()
)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each non-null key, by the given columns, nulls before all values."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def code_nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Nodes as last loaded; only the named columns, if any are named."""
    rows = table(spark, sf_dir, "nodes")
    if columns:
        rows = rows.select("id", "loaded_at", *[c for c in columns if c not in ("id", "loaded_at")])
    rows = latest(rows, "id", "loaded_at")
    return rows.select("id", *columns) if columns else rows


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").select("id").where("id is not null").distinct()


def code_edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Distinct (src, dst, edge_type) with a normal type and both ends among the nodes."""
    rows = table(spark, sf_dir, "edges").select("src", "dst", F.upper(F.trim("edge_type")).alias("edge_type"))
    if types:
        rows = rows.where(F.col("edge_type").isin(*types))
    ids = node_ids(spark, sf_dir)
    for end in ("src", "dst"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return rows.select("src", "dst", "edge_type").distinct()


def memory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "memory_nodes"), "id", "updated_at", "created_at")


def memory_edges(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    rows = table(spark, sf_dir, "memory_edges").select("src", "dst", "relationship_name", "edge_text").distinct()
    return rows.where(F.col("relationship_name").isin(*relations)) if relations else rows
