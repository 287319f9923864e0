"""The records of the test tables that the operators of this package work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import table

FUNCTION_TYPES = ("function_definition", "method_declaration", "method_definition")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").where(F.col("node_type").isin(*FUNCTION_TYPES))
