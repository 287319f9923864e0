"""How a module of queries collects them together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its name, with its SQL twin if there is one."""

        def register(run: Query) -> Query:
            self.queries[run.__name__] = run
            if sql is not None:
                self.oracle[run.__name__] = sql
            return run

        return register


#: CTEs that the SQL twins share: the last loaded row of each node, distinct edges between known nodes.
NODES_SQL = """n AS (SELECT * FROM nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
EDGES_SQL = (
    NODES_SQL
    + """, e AS (SELECT DISTINCT src, dst, upper(trim(edge_type)) AS edge_type FROM edges
  WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"""
)
MEMORY_SQL = """m AS (SELECT * FROM memory_nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1),
me AS (SELECT DISTINCT src, dst, relationship_name, edge_text FROM memory_edges)"""
