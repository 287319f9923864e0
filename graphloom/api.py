"""What callers use: stores over two tables each, a registry of named queries, recall by mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import memory, retrieval, traversal

Tool = Callable[..., DataFrame]


@dataclass
class GraphStore:
    """A property graph: nodes with an ``id``, edges with ``src``, ``dst`` and ``edge_type``."""

    nodes: DataFrame
    edges: DataFrame

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphStore:
        merged = self.nodes if nodes is None else memory.upsert_nodes(self.nodes, nodes)
        linked = self.edges if edges is None else memory.upsert_edges(self.edges, edges, merged)
        return GraphStore(merged, linked)

    def delete(self, ids: DataFrame) -> GraphStore:
        return GraphStore(*memory.delete_nodes(self.nodes, self.edges, ids))

    def get(self, ids: list[str]) -> DataFrame:
        """The nodes asked for, in the order asked; missing ones are left out."""
        asked = self.nodes.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, id string")
        return asked.join(self.nodes, "id").orderBy("pos").drop("pos")

    def neighbours(self, seeds: DataFrame, hops: int = 1, direction: str = "both") -> DataFrame:
        return traversal.neighbourhood(self.edges, seeds, hops, direction)[0]

    def path(self, start: str, end: str, max_depth: int = 5) -> DataFrame:
        return traversal.shortest_path(self.edges, start, end, max_depth)

    def has_edges(self, edges: DataFrame) -> DataFrame:
        return edges.join(self.edges, ["src", "dst", "edge_type"], "left_semi")


@dataclass
class VectorStore:
    """Vectors by collection: ``collection``, ``id``, ``text`` and ``vec``."""

    rows: DataFrame

    def search(self, collection: str, vector: list[float], k: int = 10) -> DataFrame:
        """(id, text, distance) of the k nearest; lower is nearer."""
        spark = self.rows.sparkSession
        asked = spark.createDataFrame([("", vector)], "query_id string, query_vec array<double>")
        own = self.rows.where(F.col("collection") == collection).select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "text")
        near = retrieval.nearest(own, asked, k)
        return own.select("vec_id", "text").join(near, "vec_id").select(F.col("vec_id").alias("id"), "text", "distance")


@dataclass
class ToolRegistry:
    """Named operations with aliases of their arguments and those that they need."""

    tools: dict[str, Tool] = field(default_factory=dict)
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=lambda: {"q": "query", "id": "node_id", "project": "project_id", "depth": "max_depth"})

    def register(self, name: str, tool: Tool, needs: tuple[str, ...] = ()) -> None:
        self.tools[name] = tool
        self.needs[name] = needs

    def execute(self, name: str, **arguments) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool is called {name}")
        known = {self.aliases.get(k, k): v for k, v in arguments.items()}
        missing = [n for n in self.needs[name] if known.get(n) is None]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return self.tools[name](**known)


def read_query(spark: SparkSession, sql: str, limit: int = 100, **parameters) -> DataFrame:
    """The rows of a query that only reads, at most 500; anything that writes is refused."""
    words = sql.strip().lower().split()
    if not words or words[0] not in ("select", "with", "values", "from") or ";" in sql.rstrip(" ;\n"):
        raise ValueError("only a single reading query is allowed")
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    return spark.sql(sql, args=parameters or None).limit(limit)


def query_recall(spark: SparkSession, sql: str, enabled: bool = True, limit: int = 100) -> DataFrame:
    """The recall mode whose question is a query itself; it can be switched off, and it only reads."""
    if not enabled:
        raise PermissionError("recall by query is switched off")
    return read_query(spark, sql, limit)


def timeboxed(spark: SparkSession, run: Callable[[], object], seconds: float) -> object:
    """The result of ``run``; its jobs are cancelled after the given time."""
    import threading
    import uuid

    tag = uuid.uuid4().hex
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()
        spark.removeTag(tag)


def recall(mode: str, query: str, *, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """(doc_id, score) of a query in one of the lexical modes: lexical (BM25) or jaccard."""
    asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    score = {"lexical": retrieval.bm25, "jaccard": retrieval.jaccard}.get(mode)
    if score is None:
        raise ValueError(f"no recall mode is called {mode}")
    return score(chunks, asked).orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", "score")
