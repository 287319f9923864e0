"""Deterministic parts of building the memory graph: upserts, merges, edge texts, routing rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old and new rows with the new one of each key; new values that are null keep the old ones."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    both = old.join(fresh, key, "full")
    return both.select(key, *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in fresh.columns else F.col(c) for c in old.columns if c != key])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, keys: tuple[str, str, str] = ("src", "dst", "edge_type")) -> DataFrame:
    """Distinct edges of both; new ones with an unknown end are dropped."""
    ids = nodes.select("id").distinct()
    for end in keys[:2]:
        new = new.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return old.select(*keys).unionByName(new.select(*keys)).distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes ``ids`` (id) and the edges at them."""
    kept = nodes.join(ids, "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return kept, edges


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def triplets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, relationship_name, text) of every edge between known nodes; nothing where all parts are empty."""
    s = nodes.select(F.col("id").alias("src"), F.col("text").alias("src_text"))
    d = nodes.select(F.col("id").alias("dst"), F.col("text").alias("dst_text"))
    label = F.coalesce(F.nullif(F.trim("edge_text"), F.lit("")), F.col("relationship_name"))
    parts = F.array_compact(F.array(F.nullif("src_text", F.lit("")), label, F.nullif("dst_text", F.lit(""))))
    joined = edges.join(s, "src").join(d, "dst")
    return joined.select("src", "dst", "relationship_name", F.array_join(parts, " -> ").alias("text")).where("text <> ''")


def bar_text(*parts: Column, sep: str = " | ") -> Column:
    """Parts joined by bars, empty ones left out."""
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts])), sep)


def merge_times(rows: DataFrame, key: str) -> DataFrame:
    """(key, start_ms, end_ms, confidence): the hull of the ranges and their confidence weighted by width.

    Ranges with a missing side or that end before they begin don't count.
    """
    good = rows.where("start_ms is not null and end_ms is not null and start_ms <= end_ms")
    width = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    return good.groupBy(key).agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        (F.sum(F.coalesce("confidence", F.lit(0.7)) * width) / F.sum(width)).alias("confidence"),
    )


def _join_seeds(block: np.ndarray, ids: list, seeds: list[tuple[np.ndarray, list]], threshold: float) -> list:
    """The seed of each vector of a block; new seeds are added to those of the blocks before, as (vectors, ids)."""
    hits: list = [None] * len(ids)
    left = np.arange(len(ids))
    for vectors, names in seeds:
        near = block[left] @ vectors.T >= threshold
        found = near.any(axis=1)
        for k, first in zip(left[found], near[found].argmax(axis=1)):
            hits[k] = names[first]
        left = left[~found]
        if not len(left):
            return hits
    fresh: list[int] = []
    for k in left:
        near = block[fresh] @ block[k] >= threshold if fresh else np.zeros(0, bool)
        if near.any():
            hits[k] = ids[fresh[near.argmax()]]
        else:
            hits[k] = ids[k]
            fresh.append(k)
    seeds.append((block[fresh], [ids[k] for k in fresh]))
    return hits


def greedy_clusters(rows: DataFrame, group: str, threshold: float = 0.92, block: int = 512) -> DataFrame:
    """(group, id, seed): in the order of ids each vector joins the first seed of its group it is similar to, or becomes one.

    The order decides, so a whole group is one sequence. It is read in blocks, which are
    compared with all seeds found so far; of a group only the seeds are kept in memory.
    """
    kinds = dict(rows.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seeds = object(), []
        for batch in it:
            keys, ids, vecs = (batch.column(i).to_pylist() for i in range(3))
            out: list = []
            while (k := len(out)) < len(ids):
                if keys[k] != current:
                    current, seeds = keys[k], []
                end = next((j for j in range(k, min(k + block, len(ids))) if keys[j] != current), min(k + block, len(ids)))
                vectors = np.array(vecs[k:end], dtype="float64")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                out += _join_seeds(vectors / np.where(norms == 0, 1, norms), ids[k:end], seeds, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(1).type)], names=[group, "id", "seed"])

    ordered = rows.select(group, "id", "vec").repartition(group).sortWithinPartitions(group, "id")
    return ordered.mapInArrow(run, f"`{group}` {kinds[group]}, id {kinds['id']}, seed {kinds['id']}")
