"""Building the memory graph: facets and points from texts, merges, edges, versions, splits.

All functions map DataFrames to DataFrames. What a language model would write is an
input; what follows from it by rule is computed here, by columns and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.ids import uuid5

#: Marks between the roles of an entity's description.
ROLE_MARK = "【+】"
_ROLES = r"【\+】"


def strip(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]++|(?<![\s\p{Z}])[\s\p{Z}]++$", "")


def sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` with pos, heading and body of each section; no heading where a text has no sections.

    Sections are told by 【heading】body or by lines that begin with #; the first kind that occurs holds.
    """
    t = F.regexp_replace(text, "\r\n?+", "\n")
    boxed = F.regexp_extract_all(t, F.lit(r"【([^】\n]++)】"), 1), F.slice(F.split(t, r"【[^】\n]++】"), 2, 1_000_000_000)
    hashed = F.regexp_extract_all(t, F.lit(r"(?m)^#{1,6} ++([^\n]++)$"), 1), F.slice(F.split(t, r"(?m)^#{1,6} ++[^\n]++$"), 2, 1_000_000_000)
    whole = F.array(F.lit(None).cast("string")), F.array(t)

    def zipped(kind):
        return F.arrays_zip(kind[0].alias("heading"), kind[1].alias("body"))

    found = F.when(F.size(boxed[0]) > 0, zipped(boxed)).when(F.size(hashed[0]) > 0, zipped(hashed)).otherwise(zipped(whole))
    out = documents.select("*", F.posexplode(found).alias("pos", "s"))
    return out.select(*documents.columns, "pos", F.trim("s.heading").alias("heading"), F.trim(F.regexp_replace("s.body", r"^\s++|\s++$", "")).alias("body"))


def facets_from_sections(rows: DataFrame, episode: str) -> DataFrame:
    """(episode, pos, heading, body, facet_id): one facet per different heading of an episode, the first wins."""
    named = rows.withColumn("key", T.normalize_for_id(F.col("heading"))).where("key <> ''")
    w = Window.partitionBy(episode, "key").orderBy("pos")
    first = named.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(
        episode, "pos", "heading", "body", uuid5(F.concat_ws(":", F.lit("Facet"), F.col(episode).cast("string"), F.lit("topic"), "key")).alias("facet_id")
    )


def split_long(text: Column, least: int = 200, pack: int = 80, most: int = 10) -> Column:
    """The parts of a long text: its sections, or groups of its clauses between semicolons, or the text itself."""
    parts = F.filter(F.transform(F.split(text, "【[^】]*】|\n#{1,6} "), lambda x: F.trim(x)), lambda p: p != "")
    fine = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: F.char_length(p) < 20)
    clauses = F.filter(F.transform(F.split(F.regexp_replace(text, ";", "；"), "；"), lambda x: F.trim(x)), lambda p: p != "")
    grouped = F.aggregate(
        clauses,
        F.array().cast("array<struct<t:string,n:int>>"),
        lambda groups, p: F.when(
            (F.size(groups) > 0) & (F.get(groups, F.size(groups) - 1).n + F.char_length(p) < pack),
            F.concat(
                F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.concat(F.get(groups, F.size(groups) - 1).t, F.lit("；"), p).alias("t"),
                        (F.get(groups, F.size(groups) - 1).n + F.char_length(p)).alias("n"),
                    )
                ),
            ),
        ).otherwise(F.concat(groups, F.array(F.struct(p.alias("t"), F.char_length(p).alias("n"))))),
        lambda groups: F.transform(groups, lambda g: g.t),
    )
    return (
        F.when(F.char_length(text) < least, F.array(text))
        .when(fine, F.slice(parts, 1, most))
        .when(F.size(grouped) >= 2, F.slice(grouped, 1, most))
        .otherwise(F.array(text))
    )


def merge_facets(facets: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """(group, id, target): each facet's first one of its group and type whose text or alias is its text, itself if none is.

    ``facets`` has the group, id, facet_type, text and aliases. Facets are taken in
    order, so a facet sees those before it only.
    """
    w = Window.partitionBy(group).orderBy(*order)
    rows = facets.withColumn("n", F.row_number().over(w)).withColumn("key", T.normalize_for_id(F.col("text")))
    names = F.array_distinct(F.concat(F.array("key"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.normalize_for_id)))
    known = rows.select(group, "facet_type", F.struct("n", "id").alias("first"), F.explode(names).alias("key"))
    first = known.where("key <> ''").groupBy(group, "facet_type", "key").agg(F.min("first").alias("first"))
    return rows.join(first, [group, "facet_type", "key"], "left").select(
        group, "id", F.when(F.col("first.n") < F.col("n"), F.col("first.id")).otherwise(F.col("id")).alias("target")
    )


def name_pattern(name: Column) -> Column:
    """The pattern that finds a name: whole words, with a possessive, for Latin names; anywhere for others."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.lower(name), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    edge = F.lit("(?:^|[^\\p{L}\\p{N}_])"), F.lit("(?:'s)?(?:$|[^\\p{L}\\p{N}_])")
    return F.when(name.rlike("^[ -~]+$"), F.concat(edge[0], quoted, edge[1])).otherwise(quoted)


def match_names(entities: DataFrame, facets: DataFrame, by: list[str]) -> DataFrame:
    """(entity, facet) of the names that occur in texts which share the keys ``by``.

    ``entities`` has entity, name and the keys, ``facets`` facet, text and the keys. An
    equi-join on the name's first word (its first letter, in scripts without
    spaces) finds the candidates; nothing is compared that shares no word.
    """
    head = F.when(F.col("name").rlike("^[ -~]+$"), F.get(T.tokens(F.col("name")), F.lit(0))).otherwise(F.substring("name", 1, 1))
    keyed = entities.where("trim(name) <> ''").withColumn("word", head).where("word is not null")
    letters = F.regexp_extract_all("text", F.lit(r"([^\x00-\x{24F}])"), 1)
    words = F.array_distinct(F.concat(T.tokens(F.col("text")), letters))
    texts = facets.select(*by, "facet", "text", F.explode(words).alias("word"))
    met = keyed.join(texts, [*by, "word"]).where(F.rlike(F.lower("text"), name_pattern(F.col("name"))))
    return met.select("entity", "facet").distinct()


def append_role(old: Column, new: Column, similarity: Column, threshold: float = 0.75, most: int = 50) -> Column:
    """A description with another role, unless it is similar to a known one or there are too many."""
    full = F.size(F.split(old, _ROLES)) >= most
    return F.when(new.isNull() | (F.trim(new) == ""), old).when(old.isNull() | (F.trim(old) == ""), new).when((similarity >= threshold) | full, old).otherwise(
        F.concat(old, F.lit(ROLE_MARK), new)
    )


def merge_descriptions(rows: DataFrame, key: str, order: list[str], most: int = 50) -> DataFrame:
    """(key, description, n_roles): the different descriptions of an entity in order, joined by the mark of roles.

    Descriptions are the same if they are equal but for case and marks.
    """
    own = rows.where("trim(description) <> ''").withColumn("_same", T.normalize_for_id(F.col("description")))
    first = own.groupBy(key, "_same").agg(F.min(F.struct(*order, "description")).alias("f"))
    w = Window.partitionBy(key).orderBy(*[f"f.{c}" for c in order], "f.description")
    kept = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "f.description"))), lambda x: x.description)
    return kept.groupBy(key).agg(F.array_join(listed, ROLE_MARK).alias("description"), F.count("*").alias("n_roles"))


def roles(description: Column) -> Column:
    """The roles of a description: what stands behind its first semicolon, parted by the mark."""
    return F.filter(F.split(F.regexp_replace(description, "^[^;；]*[;；]?", ""), _ROLES), lambda r: F.trim(r) != "")


def step_points(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step_no, point): the lines of five characters or more, numbered.

    A number in front of a line sets the counter, other lines count on; of equal
    lines the smallest number stays.
    """
    lines = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?+", "\n"), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", strip(F.col("line"))).where("char_length(line) >= 5")
    lines = lines.withColumn("given", F.nullif(F.regexp_extract("line", r"^([0-9]{1,4})[.)、] *", 1), F.lit("")).cast("int"))
    w = Window.partitionBy(key).orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"n": F.row_number().over(w), "last": F.last("given", ignorenulls=True).over(run)})
    at = F.last(F.when(F.col("given").isNotNull(), F.col("n")), ignorenulls=True).over(run)
    lines = lines.withColumn("step_no", F.coalesce(F.col("last") + F.col("n") - at, F.col("n")))
    point = F.regexp_replace("line", r"^[0-9]{1,4}[.)、] *|^[-*•] +", "")
    lines = lines.withColumn("point", point).withColumn("_same", T.normalize_for_id(F.col("point"))).where("_same <> ''")
    best = lines.groupBy(key, "_same").agg(F.min(F.struct("step_no", "pos", "point")).alias("b"))
    return best.select(key, "b.step_no", "b.point")


def context_points(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, kind, pos, point): the clauses of some fields, each clause once, under the first field that has it."""
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("kind"), F.col(c).alias("text")) for k, (name, c) in enumerate(fields.items())])
    each = rows.select(key, F.explode(listed).alias("f")).where("trim(f.text) <> ''")
    cut = F.regexp_replace("f.text", r"([.!?。！？]) +", "$1\n")
    parts = each.select(key, F.col("f.k").alias("_field"), "f.kind", F.posexplode(F.split(cut, "[\n；;]")).alias("pos", "point"))
    parts = parts.withColumn("point", strip(F.col("point"))).withColumn("_same", T.normalize_for_id(F.col("point"))).where("_same <> ''")
    first = parts.groupBy(key, "_same").agg(F.min(F.struct("_field", "pos", "kind", "point")).alias("b"))
    return first.select(key, "b.kind", "b.pos", "b.point")


def uncovered(anchors: Column, points: Column) -> Column:
    """The anchors that no point holds, in any case."""
    return F.filter(anchors, lambda a: ~F.exists(points, lambda p: F.contains(F.lower(p), F.lower(a))))


#: What a title loses on the way to a key: dates, versions, environments, brackets.
TITLE_NOISE = r"[0-9]{4}[-/.年][0-9]{1,2}(?:[-/.月][0-9]{1,2}日?)?|\bv?[0-9]+(?:\.[0-9]+)+\b|\b(?:prod|production|staging|test|dev)\b|\([^()]*\)|\[[^\[\]]*\]"


def identity_key(title: Column) -> Column:
    """The key that titles of one procedure share."""
    bare = F.regexp_replace(F.lower(T.narrow(title)), TITLE_NOISE, " ")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(*T.STOP_WORDS))
    return F.array_join(words, "_")


def reconcile(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(id, key, status): the first row of a key is active, other active ones are superseded, the rest stays."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("n", F.row_number().over(w))
    status = F.when(F.col("n") == 1, "active").when(F.col("status") == "active", "superseded").otherwise(F.col("status"))
    return ranked.select("id", key, status.alias("status"))


def usage(events: DataFrame, key: str, kind: str, at: str, injected: str) -> DataFrame:
    """(key, used, injected, retrieved, last_used_at) of usage events."""
    return events.groupBy(key).agg(
        F.count("*").alias("used"),
        F.count_if(F.col(kind) == injected).alias("injected"),
        F.count_if(F.coalesce(F.col(kind), F.lit("")) != injected).alias("retrieved"),
        F.max(at).alias("last_used_at"),
    )


def add_weights(edges: DataFrame, deltas: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """The edges with the sum of their deltas added to their weight."""
    sums = deltas.groupBy(*keys).agg(F.sum("delta").alias("delta"))
    return edges.join(sums, keys, "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).drop("delta")


def issues(checks: list[tuple[str, str, Column]]) -> Column:
    """The severity and name of every check that doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{severity}:{name}")) for severity, name, ok in checks]))


def split_episodes(facets: DataFrame, size: int) -> DataFrame:
    """(episode, part, title, summary, n_facets, start_ms, end_ms, confidence) of episodes with more than ``size`` facets.

    ``facets`` has episode, id, name, description and the mentioned time. Facets are
    parted in order; the summary joins 【name】description.
    """
    w = Window.partitionBy("episode").orderBy("id")
    numbered = facets.withColumns({"n": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy("episode"))}).where(F.col("of") > size)
    parts = numbered.withColumn("part", F.floor((F.col("n") - 1) / size).cast("int"))
    line = F.concat(F.lit("【"), F.coalesce("name", F.lit("")), F.lit("】"), F.coalesce("description", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "name")))
    return parts.groupBy("episode", "part").agg(
        F.get(listed, F.lit(0))["name"].alias("title"),
        F.array_join(F.transform(listed, lambda x: x.line), "").alias("summary"),
        F.count("*").alias("n_facets"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def adapted_threshold(count: Column, step: int = 5, most: int = 50) -> Column:
    return F.least(count + step, F.lit(most))


def splits_valid(splits: DataFrame, key: str) -> DataFrame:
    """(key, complete, different, in_range): whether the indices of a split are each of 0 to n - 1 once."""
    each = splits.select(key, "n", F.explode("indices").alias("i"))
    return each.groupBy(key).agg(
        (F.count_distinct("i") == F.max("n")).alias("complete"),
        (F.count_distinct("i") == F.count("*")).alias("different"),
        F.every((F.col("i") >= 0) & (F.col("i") < F.col("n"))).alias("in_range"),
    )


def snippet(text: Column, token: Column, width: int = 80) -> Column:
    """The neighbourhood of a token's first place, from a word's start to the end of its sentence; null without one."""
    at = F.instr(F.lower(text), F.lower(token))
    begin = F.greatest(at - width // 2, F.lit(1))
    raw = F.substring(text, begin, F.lit(width) + F.char_length(token))
    started = F.when(begin > 1, F.regexp_replace(raw, r"^[^\s,;.，；。]{0,20}[\s,;.，；。]+", "")).otherwise(raw)
    return F.when(at > 0, F.trim(F.regexp_replace(F.regexp_extract(started, "^([^.!?。！？]*[.!?。！？]?)", 1), r"\s+", " ")))


def write_episodes(documents: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (doc_id, title, text): an episode each, a facet per section, its points, and the chunk.

    ``entities`` (doc_id, name) are those that a model found. Nodes have id, node_type,
    node_name and search_text; ids follow from names, so a second write gives the same.
    """
    def memory_id(*parts: Column) -> Column:
        return uuid5(F.concat_ws(":", *parts))

    doc = F.col("doc_id").cast("string")
    docs = documents.where("doc_id is not null and trim(text) <> ''").select("doc_id", "title", "text", memory_id(F.lit("Episode"), doc).alias("episode"))
    parts = sections(docs).withColumn("heading", F.coalesce("heading", "title", F.lit("text")))
    facets = facets_from_sections(parts, "doc_id").join(docs.select("doc_id", "episode"), "doc_id")
    first = context_points(facets.select("facet_id", "body"), "facet_id", {"point": "body"})
    points = first.withColumn("point_id", memory_id(F.lit("Point"), F.col("facet_id"), T.normalize_for_id(F.col("point"))))

    def node(rows: DataFrame, i: str, kind: str, name: Column, text: Column) -> DataFrame:
        return rows.select(F.col(i).alias("id"), F.lit(kind).alias("node_type"), name.alias("node_name"), text.alias("search_text"))

    def edge(rows: DataFrame, a: str, b: str, kind: str, text: Column) -> DataFrame:
        return rows.select(F.col(a).alias("src"), F.col(b).cast("string").alias("dst"), F.lit(kind).alias("relationship_name"), text.alias("edge_text"))

    none = F.lit(None).cast("string")
    nodes = node(docs, "episode", "Episode", F.col("title"), none)
    nodes = nodes.unionByName(node(facets, "facet_id", "Facet", F.col("heading"), F.col("heading")))
    nodes = nodes.unionByName(node(points, "point_id", "FacetPoint", F.substring("point", 1, 50), F.col("point")))
    edges = edge(docs, "episode", "doc_id", "includes_chunk", F.lit("chunk#0"))
    edges = edges.unionByName(edge(facets, "episode", "facet_id", "has_facet", F.col("heading")))
    edges = edges.unionByName(edge(points, "facet_id", "point_id", "has_point", F.col("point")))
    if entities is not None:
        named = entities.where("trim(name) <> ''").join(docs.select("doc_id", "episode"), "doc_id").withColumn("entity", memory_id(F.lit("Entity"), T.normalize_for_id(F.col("name"))))
        nodes = nodes.unionByName(node(named, "entity", "Entity", F.col("name"), F.col("name")))
        edges = edges.unionByName(edge(named, "episode", "entity", "involves_entity", F.col("name")))
    return nodes.dropDuplicates(["id"]), edges.distinct()
