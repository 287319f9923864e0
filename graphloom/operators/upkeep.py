"""Keeping graph tables: deletes, a ledger of changes, merges of result sets, exports, projections of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

EDGE_KEYS = ("src", "dst", "relationship_name")


def delete_edges(edges: DataFrame, gone: DataFrame, keys: tuple[str, ...] = EDGE_KEYS) -> DataFrame:
    """The edges without those named in ``gone``; an edge with a null key is never named."""
    return edges.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, op, before, after): a ledger of what a new table inserts, updates and deletes against an old one.

    The values are kept as JSON; a delete is the tombstone of a row. Rows with equal values make no entry.
    """
    a = old.select(key, F.to_json(F.struct(*columns)).alias("before"))
    b = new.select(key, F.to_json(F.struct(*columns)).alias("after"))
    both = a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(key, op.alias("op"), "before", "after")


def replay(old: DataFrame, ledger: DataFrame, key: str, schema: str) -> DataFrame:
    """The new table from the old one and the ledger of its changes."""
    kept = old.join(ledger.select(key), key, "left_anti")
    fresh = ledger.where("op <> 'delete'").select(key, F.from_json("after", schema).alias("v")).select(key, "v.*")
    return kept.select(*fresh.columns).unionByName(fresh)


def delete_documents(nodes: DataFrame, edges: DataFrame, documents: DataFrame, hard: bool = False) -> DataFrame:
    """(id, reason) of the nodes that go with deleted ``documents`` (id).

    Digests that include no other document go, and entities and facets that only
    such digests hold; ``hard`` takes entities with one link left, too.
    """
    doc = documents.select(F.col("id").alias("dst")).distinct()
    held = edges.where("relationship_name = 'includes_chunk'").select("src", "dst").distinct()
    hit = held.join(doc, "dst", "left_semi").select("src").distinct()
    other = held.join(doc, "dst", "left_anti").select("src").distinct()
    digests = hit.join(other, "src", "left_anti").select(F.col("src").alias("id"), F.lit("digest").alias("reason"))
    links = edges.where("relationship_name in ('has_facet', 'involves_entity')").select("src", "dst").distinct()
    dead = digests.select(F.col("id").alias("src"))
    below = links.join(dead, "src", "left_semi").select("dst").distinct()
    alive = links.join(dead, "src", "left_anti").select("dst").distinct()
    orphans = below.join(alive, "dst", "left_anti").select(F.col("dst").alias("id"), F.lit("orphan").alias("reason"))
    out = digests.unionByName(orphans)
    if hard:
        ends = links.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(links.select(F.col("dst").alias("id"), F.col("src").alias("to")))
        loose = ends.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
        entities = nodes.where("node_type = 'Entity'").select("id").join(loose, "id", "left_semi").join(out.select("id"), "id", "left_anti")
        out = out.unionByName(entities.select("id", F.lit("degree one").alias("reason")))
    return out.join(nodes.select("id"), "id", "left_semi")


def merge_results(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The rows of several results with the first one of each key: the earlier part, then by ``order``; part tells which."""
    union = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        union = part if union is None else union.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("part", *order)
    return union.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_hits(dense: DataFrame, sparse: DataFrame, key: str) -> DataFrame:
    """(key, dense, sparse): the scores of both sets of hits, null where one misses."""
    return dense.select(key, F.col("score").alias("dense")).join(sparse.select(key, F.col("score").alias("sparse")), key, "full")


def merge_lines(old: Column, new: Column) -> Column:
    """Old lines and the new ones whose text, without numbers and marks in front, isn't there yet."""
    number = r"^\s*(?:[0-9]+[.)、]|[-*•])\s*"

    def key(x: Column) -> Column:
        return T.normalize_for_id(F.regexp_replace(x, number, ""))

    lines = F.filter(F.split(F.coalesce(old, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    known = F.transform(lines, key)
    more = F.filter(F.split(F.coalesce(new, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.array_contains(known, key(x)))
    return F.array_join(F.concat(lines, more), "\n")


def loose_chunks(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """The chunks (id, document, chunk_index) that nothing leads to, but the first of each document."""
    return chunks.where("chunk_index > 0").join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


#: Which neighbours come first when a projection must be cut.
PRIORITY = ("Episode", "Facet", "FacetPoint", "Entity")


def project(hits: DataFrame, nodes: DataFrame, edges: DataFrame, relevant: int = 300, neighbours: int = 600) -> tuple[DataFrame, DataFrame]:
    """(nodes with phase, edges): the best hits, their neighbours by type and distance, and the edges among them.

    ``hits`` has id and d. The numbers are what the search keeps: the caps are its feature.
    """
    best = hits.orderBy("d", "id").limit(relevant)
    links = edges.select("src", "dst").distinct()
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.join(best.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    near = near.join(best.select("id"), "id", "left_anti").join(nodes.select("id", "node_type"), "id").join(hits, "id", "left")
    prio = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("node_type"))
    cut = near.orderBy(F.when(prio == 0, 9).otherwise(prio), F.asc_nulls_last("d"), "id").limit(neighbours)
    kept = best.select("id", F.lit(1).alias("phase")).unionByName(cut.select("id", F.lit(2).alias("phase")))
    inner = links.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inner


def evidence(points: DataFrame, chunks: DataFrame, allowed: DataFrame, k: int = 2) -> DataFrame:
    """(point, chunk, score, rank): of each point's ``k`` most similar chunks those that are allowed for it.

    Points and chunks have id, key and words; only pairs of one key that share a word
    are compared, the others have similarity 0. The best are taken before the
    allowed ones are filtered.
    """
    p = points.select(F.col("id").alias("point"), "key", F.size("words").alias("np"), F.explode("words").alias("word"))
    c = chunks.select(F.col("id").alias("chunk"), "key", F.size("words").alias("nc"), F.explode("words").alias("word"))
    shared = p.join(c, ["key", "word"]).groupBy("point", "chunk", "np", "nc").agg(F.count("*").alias("n"))
    scored = shared.select("point", "chunk", F.round(F.col("n") / F.sqrt(F.col("np") * F.col("nc")), 6).alias("score"))
    w = Window.partitionBy("point").orderBy(F.desc("score"), "chunk")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(allowed, ["point", "chunk"], "left_semi")


def flat_props(props: Column) -> Column:
    """A JSON object as a map of strings: weights spread as weight_k, other objects and lists under key_json."""
    entries = F.map_entries(F.from_json(props, "map<string,string>"))
    spread = F.flatten(
        F.transform(
            entries,
            lambda e: F.when(
                e.key == "weights",
                F.transform(F.map_entries(F.from_json(e.value, "map<string,string>")), lambda w: F.struct(F.concat(F.lit("weight_"), w.key).alias("key"), w.value.alias("value"))),
            )
            .when(e.value.rlike(r"^[\[{]"), F.array(F.struct(F.concat(e.key, F.lit("_json")).alias("key"), e.value.alias("value"))))
            .otherwise(F.array(F.struct(e.key.alias("key"), e.value.alias("value")))),
        )
    )
    return F.map_from_entries(spread)


#: Names that say nothing as an alias or handle.
GENERIC = "summary details information content topic thing item data note text other misc".split()


def clean_aliases(aliases: Column, text: Column, most: int = 10) -> Column:
    """Aliases of three to fifty characters that say something, once each, other than the text itself."""
    own = T.normalize_for_id(F.coalesce(text, F.lit("")))
    fit = F.filter(
        F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(T.narrow(a))),
        lambda a: F.char_length(a).between(3, 50)
        & ~F.lower(a).rlike(r"^(the|this|it|there)\s")
        & ~F.lower(a).isin(*GENERIC)
        & (T.normalize_for_id(a) != own),
    )
    keys = F.transform(fit, lambda a: T.normalize_for_id(a))
    first = F.filter(fit, lambda a, k: F.array_position(keys, T.normalize_for_id(a)) == k + 1)
    return F.slice(first, 1, most)


def bad_handle(text: Column) -> Column:
    """Whether a point's handle is too generic, a paragraph, or short without anything that anchors it."""
    key = T.normalize_for_id(text)
    marks = F.char_length(text) - F.char_length(F.translate(text, "。；", ""))
    anchored = text.rlike(r"[0-9]|[A-Z][a-z]+[A-Z]|[a-z]_[a-z]")
    vague = F.lower(text).rlike(r"\b(" + "|".join(GENERIC) + r")\b")
    return (F.char_length(key) < 3) | key.isin(*GENERIC) | (marks > 1) | F.contains(text, F.lit("\n")) | (F.char_length(text) > 100) | ((F.char_length(text) < 15) & ~anchored & vague)


def export_csv(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as CSV folders nodes and edges, replacing what is there: labels joined by colons, properties as JSON."""
    n = nodes.select("id", F.array_join("labels", ":").alias("labels"), F.col("node_type").alias("type"), F.col("node_name").alias("name"), "code", "file_path", "line_start", "line_end")
    e = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "edge_type", F.col("props_json").alias("properties"))
    for rows, name in ((n, "nodes"), (e, "edges")):
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def import_csv(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of an exported graph."""
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    nodes = read.csv(f"{folder}/nodes").withColumn("labels", F.split("labels", ":"))
    return nodes, read.csv(f"{folder}/edges")


def objects_to_graph(rows: DataFrame, key: str, relations: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of nested objects: each relation is an array of structs with the key, which become nodes.

    ``relations`` names the type of what each relation holds.
    """
    def node(frame: DataFrame, kind: str) -> DataFrame:
        plain = [c for c, t in frame.dtypes if not t.startswith("array<struct") and c != key]
        props = F.to_json(F.struct(*plain)) if plain else F.lit("{}")
        return frame.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("node_type"), props.alias("props_json"))

    nodes, edges = node(rows, "Root"), None
    for name, kind in relations.items():
        each = rows.select(F.col(key).cast("string").alias("src"), F.explode(name).alias("v"))
        nodes = nodes.unionByName(node(each.select("v.*"), kind))
        link = each.where(F.col(f"v.{key}").isNotNull()).select("src", F.col(f"v.{key}").cast("string").alias("dst"), F.lit(name).alias("relationship_name"))
        edges = link if edges is None else edges.unionByName(link)
    return nodes.dropDuplicates(["id"]), edges.distinct()
