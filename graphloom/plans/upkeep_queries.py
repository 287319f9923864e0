"""Queries of deletes, ledgers, merges of results, projections of hits, and checks of names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import retrieval as R
from graphloom.operators import upkeep as U
from graphloom.plans.catalog import MEMORY_SQL, NODES_SQL, Catalog
from graphloom.plans.hits import HITS_SQL, hits
from graphloom.sources.graph_tables import memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()
_KEYS = ["src", "dst", "relationship_name"]


def _norm(x: str) -> str:
    return f"regexp_replace(lower(translate({x}, '{T.WIDE}', '{T.NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT DISTINCT src, dst, relationship_name FROM me), gone AS (SELECT src, dst, relationship_name FROM x WHERE relationship_name = 'has_point' AND dst IN (SELECT id FROM m WHERE status = 'deprecated'))
SELECT src, dst, relationship_name FROM x WHERE (src, dst, relationship_name) NOT IN (SELECT src, dst, relationship_name FROM gone WHERE src IS NOT NULL) OR src IS NULL OR dst IS NULL OR relationship_name IS NULL"""
)
def deleted_edges(spark, sf_dir):
    """The edges that are left when those to deprecated points are deleted."""
    edges = memory_edges(spark, sf_dir).select(*_KEYS).distinct()
    old = memory_nodes(spark, sf_dir).where("status = 'deprecated'").select(F.col("id").alias("dst"))
    return U.delete_edges(edges, edges.where("relationship_name = 'has_point'").join(old, "dst", "left_semi"))


_FIRST = "(SELECT * FROM memory_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS FIRST, created_at NULLS FIRST) = 1)"


@catalog.query(
    f"""WITH {MEMORY_SQL}, a AS (SELECT * FROM {_FIRST} WHERE node_type <> 'Entity'), b AS (SELECT * FROM m WHERE node_type <> 'Episode')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS op FROM a FULL JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status OR a.node_name IS DISTINCT FROM b.node_name"""
)
def change_ledger(spark, sf_dir):
    """What turns first deliveries without entities into last ones without episodes."""
    rows = table(spark, sf_dir, "memory_nodes").where("id is not null")
    w = Window.partitionBy("id").orderBy(F.asc_nulls_first("updated_at"), F.asc_nulls_first("created_at"))
    old = rows.withColumn("n", F.row_number().over(w)).where("n = 1 and node_type <> 'Entity'")
    new = memory_nodes(spark, sf_dir).where("node_type <> 'Episode'")
    return U.changes(old, new, "id", ["status", "node_name"]).select("id", "op")


_DELETED = """x AS (SELECT DISTINCT src, dst, relationship_name FROM me), inc AS (SELECT DISTINCT src, dst FROM x WHERE relationship_name = 'includes_chunk'),
gone AS (SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_type = 'text'), dig AS (SELECT DISTINCT src AS id FROM inc WHERE dst IN (SELECT id FROM gone) AND src NOT IN (SELECT src FROM inc WHERE dst NOT IN (SELECT id FROM gone))),
l AS (SELECT DISTINCT src, dst FROM x WHERE relationship_name IN ('has_facet', 'involves_entity')), orphan AS (SELECT DISTINCT dst AS id FROM l WHERE src IN (SELECT id FROM dig) AND dst NOT IN (SELECT dst FROM l WHERE src NOT IN (SELECT id FROM dig))),
soft AS (SELECT id, 'digest' AS reason FROM dig UNION ALL SELECT id, 'orphan' FROM orphan)"""


@catalog.query(f"WITH {MEMORY_SQL}, {_DELETED} SELECT id, reason FROM soft WHERE id IN (SELECT id FROM m)")
def document_delete_soft(spark, sf_dir):
    """What goes with all documents of type text."""
    docs = table(spark, sf_dir, "documents").where("doc_type = 'text'").select(F.col("doc_id").cast("string").alias("id"))
    return U.delete_documents(memory_nodes(spark, sf_dir), memory_edges(spark, sf_dir), docs)


@catalog.query(
    f"""WITH {MEMORY_SQL}, {_DELETED}, k AS (SELECT id FROM (SELECT src AS id, dst AS o FROM l UNION ALL SELECT dst, src FROM l) GROUP BY id HAVING count(*) = 1)
SELECT id, reason FROM soft WHERE id IN (SELECT id FROM m) UNION ALL SELECT id, 'degree one' FROM m WHERE node_type = 'Entity' AND id IN (SELECT id FROM k) AND id NOT IN (SELECT id FROM soft)"""
)
def document_delete_hard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_type = 'text'").select(F.col("doc_id").cast("string").alias("id"))
    return U.delete_documents(memory_nodes(spark, sf_dir), memory_edges(spark, sf_dir), docs, hard=True)


_PARTS = """p0 AS (SELECT DISTINCT me.src, me.dst, me.relationship_name, 0 AS part FROM me JOIN m ON m.id = me.src WHERE m.memory_type = 'episodic'), p1 AS (SELECT DISTINCT me.src, me.dst, me.relationship_name, 1 AS part FROM me JOIN m ON m.id = me.src WHERE m.memory_type = 'atomic'),
p2 AS (SELECT DISTINCT src, dst, relationship_name, 2 AS part FROM me WHERE src IS NOT NULL AND dst IS NOT NULL)"""


@catalog.query(
    f"""WITH {MEMORY_SQL}, {_PARTS} SELECT src, dst, relationship_name, part FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) QUALIFY row_number() OVER (PARTITION BY src, dst, relationship_name ORDER BY part) = 1"""
)
def merged_results(spark, sf_dir):
    """Episodic edges, then atomic ones, then all others, each edge once."""
    edges = memory_edges(spark, sf_dir).select(*_KEYS).distinct()
    kinds = memory_nodes(spark, sf_dir).select(F.col("id").alias("src"), "memory_type")
    typed = edges.join(kinds, "src")
    parts = [typed.where(F.col("memory_type") == t).select(*_KEYS) for t in ("episodic", "atomic")]
    return U.merge_results([*parts, edges.where("src is not null and dst is not null")], _KEYS, [])


@catalog.query(
    f"""WITH {MEMORY_SQL}, b AS (SELECT id, 0 AS part, 'summary' AS field FROM m WHERE summary IS NOT NULL UNION ALL SELECT id, 1, 'description' FROM m WHERE description IS NOT NULL UNION ALL SELECT id, 2, 'search_text' FROM m WHERE search_text IS NOT NULL)
SELECT id, field, part FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY part) = 1"""
)
def parallel_merge(spark, sf_dir):
    """The outputs of three branches in their order, each id from the first that has it."""
    nodes = memory_nodes(spark, sf_dir)
    branches = [nodes.where(F.col(c).isNotNull()).select("id", F.lit(c).alias("field")) for c in ("summary", "description", "search_text")]
    return U.merge_results(branches, ["id"], [])


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, s AS (SELECT id, 1.0 AS score FROM m WHERE contains(lower(coalesce(summary, search_text, description, node_name, '')), 'index'))
SELECT coalesce(h.id, s.id) AS id, h.d AS dense, s.score::DOUBLE AS sparse FROM h FULL JOIN s ON h.id = s.id"""
)
def hit_union(spark, sf_dir):
    """The hits by rank and those that hold a word, with both scores."""
    text = F.lower(F.coalesce("summary", "search_text", "description", "node_name", F.lit("")))
    sparse = memory_nodes(spark, sf_dir).where(F.contains(text, F.lit("index"))).select("id", F.lit(1.0).alias("score"))
    return U.union_hits(hits(spark, sf_dir).select("id", F.col("d").alias("score")), sparse, "id")


_LINE_KEY = _norm("regexp_replace(x, '^\\s*(?:[0-9]+[.)、]|[-*•])\\s*', '')")


@catalog.query(
    f"""WITH t AS (SELECT doc_id, text AS new, lag(text) OVER (PARTITION BY dataset_id ORDER BY doc_id) AS old FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(string_split(old, chr(10)), lambda x: trim(x) <> '') AS a, list_filter(string_split(new, chr(10)), lambda x: trim(x) <> '') AS b FROM t WHERE old IS NOT NULL),
k AS (SELECT doc_id, a, b, list_transform(a, lambda x: {_LINE_KEY}) AS keys FROM l)
SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(keys, {_LINE_KEY}))), chr(10)) AS merged FROM k"""
)
def merged_lines(spark, sf_dir):
    """Each text's new lines behind those of the text before it in its dataset."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "dataset_id", "text")
    old = F.lag("text").over(Window.partitionBy("dataset_id").orderBy("doc_id"))
    return docs.withColumn("old", old).where("old is not null").select("doc_id", U.merge_lines(F.col("old"), F.col("text")).alias("merged"))


@catalog.query(
    """WITH c AS (SELECT doc_id AS id, dataset_id AS document, row_number() OVER (PARTITION BY dataset_id ORDER BY doc_id) - 1 AS chunk_index, lag(doc_id) OVER (PARTITION BY dataset_id ORDER BY doc_id) AS before FROM documents WHERE dataset_id IS NOT NULL)
SELECT id, document, chunk_index FROM c WHERE chunk_index > 0 AND before % 7 = 0"""
)
def loose_chunks(spark, sf_dir):
    """Chunks behind a gap: the links from every seventh document are missing. The first of a dataset never counts."""
    docs = table(spark, sf_dir, "documents").where("dataset_id is not null")
    w = Window.partitionBy("dataset_id").orderBy("doc_id")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("dataset_id").alias("document"), (F.row_number().over(w) - 1).alias("chunk_index"), F.lag("doc_id").over(w).alias("before"))
    links = chunks.where("before is not null and before % 7 <> 0").select(F.col("before").alias("src"), F.col("id").alias("dst"))
    return U.loose_chunks(chunks.select("id", "document", "chunk_index"), links)


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, b AS (SELECT id FROM h ORDER BY d, id LIMIT 300), l AS (SELECT DISTINCT src, dst FROM me), w AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
r AS (SELECT DISTINCT w.dst AS id FROM w JOIN b ON b.id = w.src WHERE w.dst NOT IN (SELECT id FROM b)), c AS (SELECT r.id FROM r JOIN m USING (id) LEFT JOIN h USING (id) ORDER BY coalesce(list_position(['Episode', 'Facet', 'FacetPoint', 'Entity'], m.node_type), 9), h.d NULLS LAST, r.id LIMIT 600),
k AS (SELECT id, 1 AS phase FROM b UNION ALL SELECT id, 2 FROM c) SELECT k.id, phase, count(l.src) AS edges FROM k LEFT JOIN (SELECT * FROM l WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)) l ON k.id IN (l.src, l.dst) GROUP BY 1, 2"""
)
def two_phase_projection(spark, sf_dir):
    """The hits of a question, their neighbours, and how many edges of the projection touch each."""
    found = hits(spark, sf_dir).select("id", "d")
    kept, inner = U.project(found, memory_nodes(spark, sf_dir), memory_edges(spark, sf_dir))
    ends = inner.select(F.col("src").alias("id"), "src", "dst").union(inner.where("src <> dst").select("dst", "src", "dst"))
    return kept.join(ends.groupBy("id").agg(F.count("*").alias("edges")), "id", "left").fillna(0, ["edges"])


@catalog.query(
    rf"""WITH {MEMORY_SQL}, c AS (SELECT src AS facet, dst AS doc FROM (SELECT DISTINCT f.dst AS src, i.dst FROM me f JOIN me i ON i.src = f.src AND i.relationship_name = 'includes_chunk' WHERE f.relationship_name = 'has_facet')),
p AS (SELECT DISTINCT h.dst AS point, h.src AS facet, list_distinct(regexp_extract_all(lower(m.search_text), '([\p{{L}}\p{{N}}_]+)', 1)) AS words FROM me h JOIN m ON m.id = h.dst WHERE relationship_name = 'has_point' AND m.search_text IS NOT NULL),
d AS (SELECT doc_id::VARCHAR AS id, list_distinct(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1)) AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT point, c.doc AS chunk, round(len(list_intersect(p.words, d.words)) / sqrt(len(p.words) * len(d.words)), 6) AS score FROM p JOIN c USING (facet) JOIN d ON d.id = c.doc WHERE len(list_intersect(p.words, d.words)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY score DESC, chunk) AS rank FROM (SELECT DISTINCT * FROM s)) SELECT point, chunk, score, rank FROM r WHERE rank <= 2 AND chunk IN (SELECT doc_id::VARCHAR FROM documents WHERE lang IS NOT NULL)"""
)
def point_evidence(spark, sf_dir):
    """The two chunks of its episode that are most similar to a point, then those with a known language."""
    edges = memory_edges(spark, sf_dir)

    def rel(name, a, b):
        return edges.where(F.col("relationship_name") == name).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()

    held = rel("has_facet", "episode", "key").join(rel("includes_chunk", "episode", "doc"), "episode").select("key", "doc").distinct()
    texts = memory_nodes(spark, sf_dir).where("search_text is not null").select("id", F.array_distinct(T.tokens(F.col("search_text"))).alias("words"))
    points = rel("has_point", "key", "id").join(texts, "id")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = docs.select(F.col("doc_id").cast("string").alias("doc"), "lang", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    chunks = held.join(words, "doc").select(F.col("doc").alias("id"), "key", "words", "lang")
    allowed = points.select(F.col("id").alias("point"), "key").join(chunks.where("lang is not null").select("key", F.col("id").alias("chunk")), "key").select("point", "chunk").distinct()
    return U.evidence(points, chunks.drop("lang"), allowed)


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT DISTINCT src AS episode, dst AS facet FROM me WHERE relationship_name = 'has_facet'), p AS (SELECT DISTINCT src AS facet, dst AS point FROM me WHERE relationship_name = 'has_point'), e AS (SELECT DISTINCT src AS episode, dst AS entity FROM me WHERE relationship_name = 'involves_entity')
SELECT episode, 'facet' AS kind, facet AS id, 1 AS hops FROM f UNION SELECT f.episode, 'point', p.point, 2 FROM f JOIN p USING (facet) UNION SELECT episode, 'entity', entity, 1 FROM e WHERE episode IN (SELECT episode FROM f) UNION SELECT f.episode, 'facet entity', e.entity, 2 FROM f JOIN e ON e.episode = f.facet"""
)
def episode_subgraph(spark, sf_dir):
    """What lies within two typed steps of each episode."""
    edges = memory_edges(spark, sf_dir)

    def rel(name, a, b):
        return edges.where(F.col("relationship_name") == name).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()

    f, p, e = rel("has_facet", "episode", "facet"), rel("has_point", "facet", "point"), rel("involves_entity", "holder", "entity")

    def out(rows, kind, c, hops):
        return rows.select("episode", F.lit(kind).alias("kind"), F.col(c).alias("id"), F.lit(hops).alias("hops"))

    own = e.join(f.select(F.col("episode").alias("holder")).distinct(), "holder", "left_semi").withColumnRenamed("holder", "episode")
    parts = [out(f, "facet", "facet", 1), out(f.join(p, "facet"), "point", "point", 2), out(own, "entity", "entity", 1), out(f.join(e.withColumnRenamed("holder", "facet"), "facet"), "facet entity", "entity", 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


_FIT = f"""list_filter(list_transform(coalesce(aliases, []), lambda a: trim(translate(a, '{T.WIDE}', '{T.NARROW}'))), lambda a: length(a) BETWEEN 3 AND 50 AND NOT regexp_matches(lower(a), '^(the|this|it|there)\\s')
AND lower(a) NOT IN ({', '.join(f"'{w}'" for w in U.GENERIC)}) AND {_norm('a')} <> {_norm("coalesce(search_text, '')")})"""


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT id, search_text, {_FIT} AS fit FROM m WHERE node_type = 'Facet'), k AS (SELECT id, fit, list_transform(fit, lambda a: {_norm('a')}) AS keys FROM f)
SELECT id, array_to_string(list_filter(fit, lambda a, i: list_position(keys, {_norm('a')}) = i)[:10], ',') AS aliases FROM k"""
)
def cleaned_aliases(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).where("node_type = 'Facet'")
    return rows.select("id", F.array_join(U.clean_aliases(F.col("aliases"), F.col("search_text")), ",").alias("aliases"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, t AS (SELECT id, coalesce(search_text, node_name) AS x FROM m WHERE coalesce(search_text, node_name) IS NOT NULL)
SELECT id, length({_norm('x')}) < 3 OR {_norm('x')} IN ({', '.join(f"'{w}'" for w in U.GENERIC)}) OR length(x) - length(translate(x, '。；', '')) > 1 OR contains(x, chr(10)) OR length(x) > 100
OR (length(x) < 15 AND NOT regexp_matches(x, '[0-9]|[A-Z][a-z]+[A-Z]|[a-z]_[a-z]') AND regexp_matches(lower(x), '\\b({'|'.join(U.GENERIC)})\\b')) AS bad FROM t"""
)
def point_handles(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).select("id", F.coalesce("search_text", "node_name").alias("x")).where("x is not null")
    return rows.select("id", U.bad_handle(F.col("x")).alias("bad"))


@catalog.query(
    """WITH p AS (SELECT DISTINCT id, file_path FROM nodes WHERE node_type = 'file' AND id IS NOT NULL) SELECT id FROM p WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM source_files WHERE file_path IS NOT NULL)"""
)
def orphan_records(spark, sf_dir):
    """File records without a file."""
    files = table(spark, sf_dir, "source_files").select("file_path").distinct()
    rows = table(spark, sf_dir, "nodes").where("node_type = 'file' and id is not null").select("id", "file_path").distinct()
    return rows.join(files, "file_path", "left_anti").select("id")


@catalog.query(
    f"""WITH {MEMORY_SQL}, s AS (SELECT DISTINCT dst FROM me WHERE relationship_name = 'involves_entity'), w AS (SELECT id FROM m WHERE id IN (SELECT dst FROM s) OR id IN (SELECT src FROM me WHERE relationship_name = 'involves_entity'))
SELECT id, node_type FROM m WHERE id IN (SELECT id FROM w)"""
)
def memory_space(spark, sf_dir):
    """The nodes that belong to the space which entities and their holders make up."""
    links = memory_edges(spark, sf_dir, "involves_entity")
    inside = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    return memory_nodes(spark, sf_dir).select("id", "node_type").join(inside, "id", "left_semi")


@catalog.query(
    """WITH acl AS (SELECT DISTINCT dataset_id FROM memory_nodes WHERE status = 'active' AND dataset_id IS NOT NULL), own AS (SELECT dataset_id FROM memory_nodes WHERE node_type = 'Episode' AND dataset_id IS NOT NULL GROUP BY 1)
SELECT doc_id FROM documents WHERE dataset_id IN (SELECT dataset_id FROM acl) AND dataset_id IN (SELECT dataset_id FROM own)"""
)
def readable_documents(spark, sf_dir):
    """Documents of datasets that may be read (with an active node) and are owned (with an episode)."""
    nodes = table(spark, sf_dir, "memory_nodes").where("dataset_id is not null")
    docs = table(spark, sf_dir, "documents").select("doc_id", "dataset_id")
    read, owned = nodes.where("status = 'active'").select("dataset_id"), nodes.where("node_type = 'Episode'").select("dataset_id")
    return docs.join(read, "dataset_id", "left_semi").join(owned, "dataset_id", "left_semi").select("doc_id")


@catalog.query(
    "SELECT id, year(t) AS y, month(t) AS mo, day(t) AS d, hour(t) AS h, minute(t) AS mi, second(t) AS s FROM (SELECT DISTINCT id, make_timestamp(mentioned_time_start_ms * 1000) AS t FROM memory_nodes WHERE mentioned_time_start_ms IS NOT NULL)"
)
def time_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "memory_nodes").where("mentioned_time_start_ms is not null").select("id", F.timestamp_millis("mentioned_time_start_ms").alias("t")).distinct()
    parts = {"y": F.year, "mo": F.month, "d": F.day, "h": F.hour, "mi": F.minute, "s": F.second}
    return rows.select("id", *(f("t").alias(name) for name, f in parts.items()))


@catalog.query("SELECT src, dst, 'line' AS key, json_extract_string(props_json, '$.line') AS value FROM (SELECT DISTINCT src, dst, props_json FROM edges WHERE props_json IS NOT NULL)")
def flat_edge_props(spark, sf_dir):
    rows = table(spark, sf_dir, "edges").where("props_json is not null").select("src", "dst", "props_json").distinct()
    return rows.select("src", "dst", F.explode(U.flat_props(F.col("props_json"))))


@catalog.query("SELECT dataset_id, count(*) AS n FROM documents WHERE starts_with(coalesce(dataset_id, ''), 'ds-00') GROUP BY 1")
def dataset_prefix(spark, sf_dir):
    """Documents of the datasets whose name begins alike; a missing name counts as empty."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.startswith(F.coalesce("dataset_id", F.lit("")), F.lit("ds-00"))).groupBy("dataset_id").agg(F.count("*").alias("n"))


@catalog.query(
    """SELECT 'dataset' AS scope, coalesce(dataset_id, '') AS name, count(DISTINCT doc_id) AS entries FROM documents GROUP BY ALL UNION ALL SELECT 'user', coalesce(source, ''), count(DISTINCT doc_id) FROM documents GROUP BY ALL UNION ALL SELECT 'all', '', count(DISTINCT doc_id) FROM documents"""
)
def deletion_counts(spark, sf_dir):
    """How many entries a delete of a dataset, of a source or of everything concerns."""
    docs = table(spark, sf_dir, "documents")
    n = F.count_distinct("doc_id").alias("entries")

    def by(scope, column):
        return docs.groupBy(F.coalesce(column, F.lit("")).alias("name")).agg(n).select(F.lit(scope).alias("scope"), "name", "entries")

    return by("dataset", "dataset_id").unionByName(by("user", "source")).unionByName(docs.agg(n).select(F.lit("all").alias("scope"), F.lit("").alias("name"), "entries"))


@catalog.query("SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean_value, count(*) FILTER (value IS NULL OR value < 1) AS retries FROM events GROUP BY 1")
def call_summary(spark, sf_dir):
    """Calls by module with their mean and how many were to be tried again."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) < 1).alias("retries")
    )


_WORDS = "regexp_extract_all(lower(replace(regexp_replace(node_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '([\\p{L}\\p{N}_]+)', 1)"


@catalog.query(
    f"""WITH {NODES_SQL}, {MEMORY_SQL.replace('m AS', 'mm AS', 1).replace('me AS', 'mme AS', 1)}, q AS (SELECT DISTINCT lower(canonical_name) AS query FROM mm WHERE trim(canonical_name) <> ''), k AS (SELECT id, lower(node_name) AS name, {_WORDS} AS words FROM n WHERE node_type = 'class_definition' AND node_name IS NOT NULL),
a AS (SELECT query, id, 1.0 AS score FROM q JOIN (SELECT DISTINCT id, unnest(words) AS word FROM k) w ON w.word = q.query), b AS (SELECT query, k.id, 0.5 AS score FROM q JOIN k ON contains(k.name, q.query) WHERE query NOT IN (SELECT query FROM a))
SELECT query, id, score::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""
)
def search_with_fallback(spark, sf_dir):
    """Classes with a word, else those whose name contains it, with half the score."""
    from graphloom.operators import codeflow as X
    from graphloom.sources.graph_tables import code_nodes

    asked = memory_nodes(spark, sf_dir).where("trim(canonical_name) <> ''").select(F.lower("canonical_name").alias("query")).distinct()
    classes = code_nodes(spark, sf_dir, "node_type", "node_name").where("node_type = 'class_definition' and node_name is not null")
    words = classes.select("id", F.explode(F.array_distinct(X.words_of_name(F.col("node_name")))).alias("query"))
    exact = asked.join(words, "query").select("query", "id", F.lit(1.0).alias("score"))
    left = asked.join(exact.select("query").distinct(), "query", "left_anti")
    # parts of a name of the length of a query, so the fallback is an equi-join, too; as many lengths as names can have
    sizes = left.select(F.char_length("query").alias("n")).distinct()
    name = F.lower("node_name")
    cut = classes.select("id", name.alias("name")).join(F.broadcast(sizes.where("n >= 1")), F.char_length("name") >= F.col("n"))
    parts = cut.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - F.col("n") + 1), lambda k: F.substring(F.col("name"), k, F.col("n"))))).alias("query"))
    loose = left.join(parts, "query").distinct().select("query", "id", F.lit(0.5).alias("score"))
    return R.top_k(exact.unionByName(loose), ["query"], [F.desc("score"), F.col("id")], 10).select("query", "id", "score")


@catalog.query(
    r"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(code, '(https?://[A-Za-z0-9./_-]+)', 1)) AS url FROM source_files WHERE code IS NOT NULL), p AS (SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) AS path FROM u)
SELECT 'page' AS node_type, url AS id, nullif(path, '') AS value, 1 AS pages FROM p UNION ALL SELECT 'site', host, NULL, count(*) FROM p GROUP BY host UNION ALL SELECT 'edge', url, host, 1 FROM p"""
)
def web_graph(spark, sf_dir):
    """The pages that texts link to, their sites, and the edges from page to site."""
    found = F.regexp_extract_all("code", F.lit("(https?://[A-Za-z0-9./_-]+)"), 1)
    urls = table(spark, sf_dir, "source_files").where("code is not null").select(F.explode(found).alias("url")).distinct()
    p = urls.select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/.*)?$", 1).alias("path"))
    none = F.lit(None).cast("string")
    pages = p.select(F.lit("page").alias("node_type"), F.col("url").alias("id"), F.nullif("path", F.lit("")).alias("value"), F.lit(1).cast("long").alias("pages"))
    sites = p.groupBy("host").agg(F.count("*").alias("pages")).select(F.lit("site").alias("node_type"), F.col("host").alias("id"), none.alias("value"), "pages")
    edges = p.select(F.lit("edge").alias("node_type"), F.col("url").alias("id"), F.col("host").alias("value"), F.lit(1).cast("long").alias("pages"))
    return pages.unionByName(sites).unionByName(edges)


@catalog.query(
    f"""WITH {NODES_SQL}, f AS (SELECT DISTINCT src, dst FROM edges WHERE upper(trim(edge_type)) = 'REACHES'), p AS (SELECT DISTINCT src, dst FROM edges WHERE upper(trim(edge_type)) = 'PARENT_OF')
SELECT DISTINCT f.src, p.src AS dst FROM f JOIN n i ON i.id = f.dst AND i.node_type = 'identifier' JOIN p ON p.dst = f.dst JOIN n o ON o.id = p.src AND o.node_type = 'assignment'"""
)
def retargeted_flow(spark, sf_dir):
    """Flow into an identifier that belongs to an assignment, led to the assignment, as from a name to its parameter."""
    from graphloom.sources.graph_tables import code_nodes

    kinds = code_nodes(spark, sf_dir, "node_type")
    rows = table(spark, sf_dir, "edges").select("src", "dst", F.upper(F.trim("edge_type")).alias("t"))
    flow = rows.where("t = 'REACHES'").select("src", F.col("dst").alias("name")).distinct()
    tree = rows.where("t = 'PARENT_OF'").select(F.col("src").alias("dst"), F.col("dst").alias("name")).distinct()
    names = kinds.where("node_type = 'identifier'").select(F.col("id").alias("name"))
    owners = kinds.where("node_type = 'assignment'").select(F.col("id").alias("dst"))
    return flow.join(names, "name", "left_semi").join(tree, "name").join(owners, "dst", "left_semi").select("src", "dst").distinct()


QUERIES, ORACLE = catalog.queries, catalog.oracle
