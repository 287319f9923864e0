"""Pipelines of stages over DataFrames, with their events, and what is written where at their end.

A stage is a function from a DataFrame to a DataFrame, so a pipeline is one plan
until something is written. Events are rows: a run can be followed, resumed and
reported with the same means as any table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import memory
from graphloom.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]
EVENTS = "run string, stage string, event string, at_ms long, detail string"


@dataclass
class Pipeline:
    """Stages by name, in order; processors run behind the last stage."""

    name: str
    stages: list[tuple[str, Step]] = field(default_factory=list)
    processors: list[Step] = field(default_factory=list)
    events: list[tuple[str, str, str, int, str]] = field(default_factory=list)

    def stage(self, name: str, step: Step) -> Pipeline:
        self.stages.append((name, step))
        return self

    def processor(self, step: Step) -> Pipeline:
        self.processors.append(step)
        return self

    def _log(self, run: str, stage: str, event: str, detail: str = "") -> None:
        self.events.append((run, stage, event, int(time.time() * 1000), detail))

    def run(self, rows: DataFrame, *, keep: bool = False) -> DataFrame:
        """The result of all stages; with ``keep`` each one is written, so that it can be counted and isn't repeated.

        The events are started, stage, and completed or failed with the reason; a failure is raised again.
        """
        run = uuid.uuid4().hex
        self._log(run, "", "started")
        here = ""
        try:
            for here, step in [*self.stages, *((f"processor {k}", p) for k, p in enumerate(self.processors))]:
                rows = step(rows)
                if keep:
                    rows = cut_lineage(rows)
                self._log(run, here, "stage", str(rows.count()) if keep else "")
        except Exception as e:
            self._log(run, here, "failed", f"{type(e).__name__}: {e}"[:500])
            raise
        self._log(run, "", "completed")
        return rows

    def event_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENTS)


def progress(events: DataFrame) -> DataFrame:
    """(run, state, stages, rows): how far each run is, by its events."""
    last = F.max_by("event", F.struct("at_ms", F.when(F.col("event").isin("completed", "failed"), 1).otherwise(0)))
    return events.groupBy("run").agg(
        last.alias("state"), F.count_if(F.col("event") == "stage").alias("stages"), F.max(F.when(F.col("event") == "stage", F.expr("try_cast(detail AS BIGINT)"))).alias("rows")
    )


def batched(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int) -> DataFrame:
    """``step`` over batches of ``size`` rows (the last of a partition may be smaller), whatever size Arrow's batches have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= size:
                whole = pd.concat(held, ignore_index=True)
                full = n - n % size
                for k in range(0, full, size):
                    yield step(whole.iloc[k : k + size].reset_index(drop=True))
                held, n = [whole.iloc[full:]], n - full
        if n:
            yield step(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, schema)


def deferred_edges(pending: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that can be written, edges that still wait): an edge waits until both of its ends are nodes."""
    ids = nodes.select("id").distinct()
    ready = pending.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*pending.columns)
    known = ids.withColumn("known", F.lit(True))
    marked = pending.join(known.select(F.col("id").alias("src"), F.col("known").alias("a")), "src", "left").join(known.select(F.col("id").alias("dst"), F.col("known").alias("b")), "dst", "left")
    return ready, marked.where("a is null or b is null").select(*pending.columns)


def persist(folder: str, nodes: DataFrame, edges: DataFrame, indexed: list[str], triplets: bool = False) -> list[str]:
    """Write the graph and its indexes under ``folder``, replacing what is there; the names of the tables that failed.

    Nodes and edges come first, and their failure is raised; an index that fails is only reported.
    """
    nodes = nodes.dropDuplicates(["id"])
    edges = edges.distinct()
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    tables: dict[str, Callable[[], DataFrame]] = {
        f"index_{c}": (lambda c=c: nodes.where(F.trim(c) != "").select("id", "node_type", F.col(c).alias("text"))) for c in indexed
    }
    tables["relation_index"] = lambda: edges.groupBy("relationship_name").agg(F.count("*").alias("number_of_edges"))
    if triplets:
        text = F.coalesce(*[F.col(c) for c in indexed], F.lit(""))
        tables["triplets"] = lambda: memory.triplets(nodes.select("id", text.alias("text")), edges)
    failed = []
    for name, make in tables.items():
        try:
            make().write.mode("overwrite").parquet(f"{folder}/{name}")
        except Exception:
            failed.append(name)
    return failed


def clear(spark: SparkSession, folder: str, tables: list[str] | None = None) -> list[str]:
    """Delete tables under ``folder``, all of them if none are named; the names of those that were there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    there = sorted(s.getPath().getName() for s in fs.listStatus(path))
    gone = [t for t in there if tables is None or t in tables]
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return gone
