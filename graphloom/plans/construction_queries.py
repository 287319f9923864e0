"""Queries of building the memory graph: sections, facets, points, merges, versions, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.functions import text as T
from graphloom.operators import construction as C
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.sources.graph_tables import memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()
_MARK = C.ROLE_MARK


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower(translate({x}, '{T.WIDE}', '{T.NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _of(spark, sf_dir, kind, *columns):
    rows = memory_nodes(spark, sf_dir).where(F.col("node_type") == kind)
    return rows.select("id", *columns) if columns else rows


def _links(spark, sf_dir, relation, src, dst):
    return memory_edges(spark, sf_dir, relation).select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


_SECTIONS = r"""d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, t, regexp_extract_all(t, '【([^】\n]+)】', 1) AS h1, regexp_split_to_array(t, '【[^】\n]+】') AS b1, regexp_extract_all(t, '(?m)^#{1,6} +([^\n]+)$', 1) AS h2, regexp_split_to_array(t, '(?m)^#{1,6} +[^\n]+$') AS b2 FROM d),
z AS (SELECT doc_id, CASE WHEN len(h1) > 0 THEN h1 WHEN len(h2) > 0 THEN h2 ELSE [NULL] END AS h, CASE WHEN len(h1) > 0 THEN b1[2:] WHEN len(h2) > 0 THEN b2[2:] ELSE [t] END AS b FROM k),
s AS (SELECT doc_id, unnest(range(len(h))) AS pos, h, b FROM z),
sections AS (SELECT doc_id, pos, trim(h[pos + 1]) AS heading, regexp_replace(b[pos + 1], '^\s+|\s+$', '', 'g') AS body FROM s)"""


@catalog.query(f"WITH {_SECTIONS} SELECT doc_id, pos, heading, trim(body) AS body FROM sections")
def text_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return C.sections(docs).select("doc_id", "pos", "heading", "body")


@catalog.query(
    f"""WITH {_SECTIONS} SELECT doc_id, pos, heading, trim(body) AS body FROM (SELECT *, {_norm('heading')} AS key FROM sections) WHERE key <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1"""
)
def facets_from_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return C.facets_from_sections(C.sections(docs), "doc_id").select("doc_id", "pos", "heading", "body")


@catalog.query()
def split_summaries(spark, sf_dir):
    """The parts of long texts by sections, or by groups of clauses; a fold over clauses has no short SQL form."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = C.split_long(F.regexp_replace("text", "\r\n?+", "\n"))
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT dataset_id, id, {_norm("coalesce(search_text, '')")} AS key, aliases, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at NULLS FIRST, id) AS n FROM m WHERE node_type = 'Facet'),
k AS (SELECT dataset_id, n, id, key FROM f UNION SELECT dataset_id, n, id, {_norm('a')} FROM (SELECT dataset_id, n, id, unnest(aliases) AS a FROM f)),
g AS (SELECT dataset_id, key, min(ROW(n, id)) AS first FROM k WHERE key <> '' GROUP BY 1, 2)
SELECT f.dataset_id, f.id, CASE WHEN g.first[1] < f.n THEN g.first[2] ELSE f.id END AS target FROM f LEFT JOIN g ON g.dataset_id IS NOT DISTINCT FROM f.dataset_id AND g.key = f.key WHERE f.dataset_id IS NOT NULL"""
)
def facet_merges(spark, sf_dir):
    rows = _of(spark, sf_dir, "Facet", "dataset_id", "created_at", F.coalesce("search_text", F.lit("")).alias("text"), "aliases", F.lit("topic").alias("facet_type"))
    return C.merge_facets(rows.where("dataset_id is not null"), "dataset_id", [F.asc_nulls_first("created_at"), F.col("id")])


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT DISTINCT src, dst, relationship_name FROM me), c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM x WHERE relationship_name = 'includes_chunk')
SELECT x.src, x.dst, x.relationship_name, array_to_string(list_filter([nullif(trim(d.node_name), ''), nullif(trim(d.description), '')], lambda v: v IS NOT NULL), ': ') AS edge_text FROM x JOIN m d ON d.id = x.dst WHERE x.relationship_name = 'has_facet'
UNION ALL SELECT x.src, x.dst, x.relationship_name, array_to_string(list_filter([nullif(trim(d.node_name), ''), nullif(trim(d.description), '')], lambda v: v IS NOT NULL), ' | ') FROM x JOIN m d ON d.id = x.dst WHERE x.relationship_name = 'involves_entity'
UNION ALL SELECT x.src, x.dst, x.relationship_name, concat(coalesce(s.node_name, ''), ' -> ', array_to_string(list_filter([nullif(trim(d.node_name), ''), nullif(trim(d.search_text), '')], lambda v: v IS NOT NULL), ': ')) FROM x JOIN m s ON s.id = x.src JOIN m d ON d.id = x.dst WHERE x.relationship_name = 'has_point'
UNION ALL SELECT src, dst, 'includes_chunk', 'chunk#' || i FROM c"""
)
def built_edges(spark, sf_dir):
    """The edges of episodes, facets, points, entities and chunks with the texts that follow from their ends."""
    from graphloom.operators.memory import bar_text

    ends = memory_nodes(spark, sf_dir).select("id", "node_name", "description", "search_text")
    d = ends.select(*(F.col(c).alias("d_" + c) for c in ends.columns))
    s = ends.select(F.col("id").alias("s_id"), F.col("node_name").alias("s_name"))
    x = memory_edges(spark, sf_dir).select("src", "dst", "relationship_name").distinct()
    named = x.where("relationship_name in ('has_facet', 'involves_entity', 'has_point')")
    both = named.join(d, F.col("dst") == F.col("d_id")).join(s, F.col("src") == F.col("s_id"), "left")
    facet = bar_text(F.col("d_node_name"), F.col("d_description"), sep=": ")
    entity = bar_text(F.col("d_node_name"), F.col("d_description"))
    point = F.concat(F.coalesce("s_name", F.lit("")), F.lit(" -> "), bar_text(F.col("d_node_name"), F.col("d_search_text"), sep=": "))
    kind = F.col("relationship_name")
    told = both.where("relationship_name <> 'has_point' or s_id is not null").select(
        "src", "dst", kind, F.when(kind == "has_facet", facet).when(kind == "involves_entity", entity).otherwise(point).alias("edge_text")
    )
    number = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    chunks = x.where("relationship_name = 'includes_chunk'").select("src", "dst", kind, F.concat(F.lit("chunk#"), number.cast("string")).alias("edge_text"))
    return told.unionByName(chunks)


@catalog.query(
    f"""WITH {MEMORY_SQL}, e AS (SELECT DISTINCT me.src AS episode, m.id AS entity, coalesce(m.canonical_name, m.node_name) AS name FROM me JOIN m ON m.id = me.dst WHERE relationship_name = 'involves_entity' AND trim(coalesce(m.canonical_name, m.node_name)) <> ''),
f AS (SELECT DISTINCT me.src AS episode, m.id AS facet, concat_ws(' ', m.search_text, m.description) AS text FROM me JOIN m ON m.id = me.dst WHERE relationship_name = 'has_facet')
SELECT DISTINCT entity, facet FROM e JOIN f USING (episode) WHERE regexp_matches(lower(text), CASE WHEN regexp_matches(name, '^[ -~]+$') THEN '(?:^|[^\\p{{L}}\\p{{N}}_])\\Q' || lower(name) || '\\E(?:''s)?(?:$|[^\\p{{L}}\\p{{N}}_])' ELSE '\\Q' || lower(name) || '\\E' END)"""
)
def facet_entity_edges(spark, sf_dir):
    """Entities of an episode whose names occur in one of its facets."""
    nodes = memory_nodes(spark, sf_dir)
    entity = nodes.select(F.col("id").alias("entity"), F.coalesce("canonical_name", "node_name").alias("name"))
    facet = nodes.select(F.col("id").alias("facet"), F.concat_ws(" ", "search_text", "description").alias("text"))
    e = _links(spark, sf_dir, "involves_entity", "episode", "entity").join(entity, "entity")
    f = _links(spark, sf_dir, "has_facet", "episode", "facet").join(facet, "facet")
    return C.match_names(e, f, ["episode"])


@catalog.query(
    rf"""WITH {MEMORY_SQL}, c AS (SELECT id AS entity, coalesce(canonical_name, node_name) AS name FROM m WHERE node_type = 'Entity' AND trim(coalesce(canonical_name, node_name)) <> ''), t AS (SELECT id AS facet, dataset_id, search_text AS text FROM m WHERE node_type IN ('Facet', 'FacetPoint'))
SELECT DISTINCT c.entity, t.facet FROM c JOIN m x ON x.id = c.entity JOIN t ON t.dataset_id = x.dataset_id WHERE regexp_matches(lower(t.text), CASE WHEN regexp_matches(name, '^[ -~]+$') THEN '(?:^|[^\p{{L}}\p{{N}}_])\Q' || lower(name) || '\E(?:''s)?(?:$|[^\p{{L}}\p{{N}}_])' ELSE '\Q' || lower(name) || '\E' END)"""
)
def names_in_texts(spark, sf_dir):
    """Entities of a dataset whose names occur in its facets and points."""
    nodes = memory_nodes(spark, sf_dir)
    e = nodes.where("node_type = 'Entity'").select("dataset_id", F.col("id").alias("entity"), F.coalesce("canonical_name", "node_name").alias("name"))
    f = nodes.where("node_type in ('Facet', 'FacetPoint')").select("dataset_id", F.col("id").alias("facet"), F.col("search_text").alias("text"))
    return C.match_names(e, f, ["dataset_id"])


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT lower(trim(canonical_name)) AS name, id, description, {_norm('description')} AS k FROM m WHERE node_type = 'Entity' AND trim(canonical_name) <> '' AND trim(description) <> ''),
y AS (SELECT name, k, min(ROW(id, description)) AS f FROM x GROUP BY 1, 2), z AS (SELECT name, f, row_number() OVER (PARTITION BY name ORDER BY f[1], f[2]) AS n FROM y)
SELECT name, string_agg(f[2], '{_MARK}' ORDER BY n) AS description, count(*) AS n_roles FROM z WHERE n <= 50 GROUP BY name"""
)
def merged_descriptions(spark, sf_dir):
    rows = _of(spark, sf_dir, "Entity", "description", F.lower(F.trim("canonical_name")).alias("name")).where("name <> ''")
    return C.merge_descriptions(rows, "name", ["id"])


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT lower(trim(canonical_name)) AS name, string_agg(description, '{_MARK}' ORDER BY id) AS d FROM m WHERE node_type = 'Entity' AND trim(canonical_name) <> '' AND trim(description) <> '' GROUP BY 1)
SELECT name, len(list_filter(string_split(d, '{_MARK}'), lambda r: trim(r) <> '')) AS n_parts, len(list_filter(string_split(regexp_replace('role; ' || d, '^[^;；]*[;；]?', ''), '{_MARK}'), lambda r: trim(r) <> '')) AS n_roles FROM x"""
)
def role_counts(spark, sf_dir):
    rows = _of(spark, sf_dir, "Entity", "description", F.lower(F.trim("canonical_name")).alias("name")).where("name <> '' and trim(description) <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "description"))), lambda x: x.description)
    joined = rows.groupBy("name").agg(F.array_join(listed, _MARK).alias("d"))
    parts = F.filter(F.split("d", C._ROLES), lambda r: F.trim(r) != "")
    return joined.select("name", F.size(parts).alias("n_parts"), F.size(C.roles(F.concat(F.lit("role; "), "d"))).alias("n_roles"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, p AS (SELECT DISTINCT me.src AS facet, m.id, m.search_text FROM me JOIN m ON m.id = me.dst WHERE relationship_name = 'has_point')
SELECT facet, count(*) AS n_points, min(ROW(id, search_text))[2] AS topic, string_agg(search_text, chr(10) ORDER BY id) AS text FROM p GROUP BY facet"""
)
def event_groups(spark, sf_dir):
    """The sentences of each group in order, with the first one as its topic; facets stand for events, points for sentences."""
    points = _links(spark, sf_dir, "has_point", "facet", "id").join(memory_nodes(spark, sf_dir).select("id", "search_text"), "id")
    listed = F.array_sort(F.collect_list(F.struct("id", "search_text")))
    text = F.array_join(F.transform(listed, lambda x: x.search_text), "\n")
    return points.groupBy("facet").agg(F.count("*").alias("n_points"), F.min(F.struct("id", "search_text"))["search_text"].alias("topic"), F.nullif(text, F.lit("")).alias("text"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, r AS (SELECT dst AS doc, min(src) AS episode FROM me WHERE relationship_name = 'includes_chunk' GROUP BY dst), d AS (SELECT doc_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY doc_id) - 1 AS chunk_index FROM documents)
SELECT d.doc_id, chunk_index, coalesce(r.episode, 'Episode:' || d.doc_id) AS episode, CASE WHEN r.episode IS NULL THEN 'new' ELSE 'existing' END AS decision, CASE WHEN r.episode IS NULL AND a.memory_type = 'atomic' THEN 'atomic' ELSE 'episodic' END AS memory_type
FROM d LEFT JOIN r ON r.doc = d.doc_id::VARCHAR LEFT JOIN (SELECT dataset_id, min(memory_type) AS memory_type FROM m WHERE node_type = 'Episode' AND memory_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT memory_type) = 1) a USING (dataset_id)"""
)
def document_routing(spark, sf_dir):
    """Which episode a document goes to: the first that includes it, else one of its own; atomic if new and all of its dataset's episodes are."""
    route = memory_edges(spark, sf_dir, "includes_chunk").groupBy(F.col("dst").alias("doc")).agg(F.min("src").alias("episode"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "dataset_id")
    number = F.row_number().over(Window.partitionBy("dataset_id").orderBy("doc_id")) - 1
    kinds = _of(spark, sf_dir, "Episode", "dataset_id", "memory_type").where("memory_type is not null and dataset_id is not null")
    atomic = kinds.groupBy("dataset_id").agg(F.every(F.col("memory_type") == "atomic").alias("atomic"))
    rows = docs.withColumn("chunk_index", number).withColumn("doc", F.col("doc_id").cast("string")).join(route, "doc", "left").join(atomic, "dataset_id", "left")
    new = F.col("episode").isNull()
    return rows.select(
        "doc_id",
        "chunk_index",
        F.coalesce("episode", F.concat(F.lit("Episode:"), "doc")).alias("episode"),
        F.when(new, "new").otherwise("existing").alias("decision"),
        F.when(new & F.coalesce("atomic", F.lit(False)), "atomic").otherwise("episodic").alias("memory_type"),
    )


@catalog.query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, pos, line, TRY_CAST(nullif(regexp_extract(line, '^([0-9]{{1,4}})[.)、] *', 1), '') AS INT) AS given FROM (SELECT doc_id, pos, {_strip('line')} AS line FROM l) WHERE length(line) >= 5),
b AS (SELECT *, row_number() OVER w AS n, last_value(given IGNORE NULLS) OVER w AS last FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, last_value(CASE WHEN given IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS since FROM b),
p AS (SELECT doc_id, pos, coalesce(last + n - since, n) AS step_no, regexp_replace(line, '^[0-9]{{1,4}}[.)、] *|^[-*•] +', '') AS point FROM c),
k AS (SELECT *, {_norm('point')} AS k FROM p) SELECT doc_id, step_no, point FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY step_no, pos) = 1"""
)
def step_points(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return C.step_points(docs, "doc_id", "text")


@catalog.query(
    rf"""WITH {MEMORY_SQL}, f AS (SELECT id, 0 AS k, 'when' AS kind, summary AS text FROM m UNION ALL SELECT id, 1, 'why', description FROM m UNION ALL SELECT id, 2, 'boundary', search_text FROM m),
s AS (SELECT id, k, kind, regexp_split_to_array(regexp_replace(text, '([.!?。！？]) +', '\1' || chr(10), 'g'), '[\n；;]') AS parts FROM f WHERE trim(text) <> ''),
p AS (SELECT id, k, kind, unnest(range(len(parts))) AS pos, parts FROM s), q AS (SELECT id, k, kind, pos, {_strip('parts[pos + 1]')} AS point FROM p), r AS (SELECT *, {_norm('point')} AS key FROM q)
SELECT id, kind, pos, point FROM r WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY k, pos) = 1"""
)
def context_points(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).select("id", "summary", "description", "search_text")
    return C.context_points(rows, "id", {"when": "summary", "why": "description", "boundary": "search_text"})


_ANCHORS = ["[0-9]+(?:\\.[0-9]+)? ?(?:%|percent|ms|seconds|days|megabytes)", "\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b", "\\b[a-z]+(?:_[a-z]+)+\\b"]
_ANCHORS_SQL = "list_concat(" + ", ".join(f"regexp_extract_all({{0}}, '({a})', 1)" for a in _ANCHORS[:2]) + ")"
_ANCHORS_SQL = f"list_concat({_ANCHORS_SQL}, regexp_extract_all({{0}}, '({_ANCHORS[2]})', 1))"


@catalog.query(
    f"""WITH {MEMORY_SQL}, p AS (SELECT me.src AS id, list(DISTINCT lower(m.search_text)) AS points FROM me JOIN m ON m.id = me.dst WHERE relationship_name = 'has_point' AND m.search_text IS NOT NULL GROUP BY 1),
a AS (SELECT id, list_distinct({_ANCHORS_SQL.format("concat_ws(' ', search_text, description)")}) AS anchors FROM m WHERE node_type = 'Facet')
SELECT a.id, len(anchors) AS n_anchors, len(list_filter(anchors, lambda x: len(list_filter(coalesce(points, []), lambda q: contains(q, lower(x)))) = 0)) AS n_uncovered FROM a LEFT JOIN p USING (id)"""
)
def coverage_gaps(spark, sf_dir):
    """How many anchors of a facet none of its points holds."""
    nodes = memory_nodes(spark, sf_dir)
    points = _links(spark, sf_dir, "has_point", "id", "point").join(nodes.select(F.col("id").alias("point"), "search_text"), "point")
    held = points.groupBy("id").agg(F.collect_set("search_text").alias("points"))
    text = F.concat_ws(" ", "search_text", "description")
    anchors = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"({a})"), 1) for a in _ANCHORS]))
    facets = nodes.where("node_type = 'Facet'").select("id", anchors.alias("anchors")).join(held, "id", "left")
    gaps = C.uncovered(F.col("anchors"), F.coalesce("points", F.array().cast("array<string>")))
    return facets.select("id", F.size("anchors").alias("n_anchors"), F.size(gaps).alias("n_uncovered"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@catalog.query(
    f"""WITH t AS (SELECT doc_id, title, regexp_replace(lower(translate(title, '{T.WIDE}', '{T.NARROW}')), '{C.TITLE_NOISE}', ' ', 'g') AS b FROM documents WHERE title IS NOT NULL),
k AS (SELECT doc_id, title, array_to_string(list_filter(string_split(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({_STOPS})), '_') AS key FROM t)
SELECT key, min(ROW(doc_id, title))[2] AS canonical_title, count(*) AS n_titles, count(DISTINCT title) AS n_aliases FROM k WHERE key <> '' GROUP BY key"""
)
def identity_keys(spark, sf_dir):
    """Titles that are one procedure's name, with the first as its title."""
    rows = table(spark, sf_dir, "documents").where("title is not null").select("doc_id", "title", C.identity_key(F.col("title")).alias("key"))
    return rows.where("key <> ''").groupBy("key").agg(
        F.min(F.struct("doc_id", "title"))["title"].alias("canonical_title"), F.count("*").alias("n_titles"), F.count_distinct("title").alias("n_aliases")
    )


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT id, coalesce(lower(trim(canonical_name)), lower(trim(node_name))) AS key, status, updated_at FROM m WHERE node_type = 'Entity'),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, id) AS n FROM x WHERE key IS NOT NULL)
SELECT id, key, CASE WHEN n = 1 THEN 'active' WHEN status = 'active' THEN 'superseded' ELSE status END AS status FROM r"""
)
def reconciled_status(spark, sf_dir):
    key = F.coalesce(F.lower(F.trim("canonical_name")), F.lower(F.trim("node_name")))
    rows = _of(spark, sf_dir, "Entity", key.alias("key"), "status", "updated_at").where("key is not null")
    return C.reconcile(rows, "key", [F.desc_nulls_last("updated_at"), F.col("id")])


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT lower(trim(canonical_name)) AS signature, min(id) AS id FROM m WHERE status = 'active' AND trim(canonical_name) <> '' GROUP BY 1"""
)
def active_by_signature(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).where("status = 'active' and trim(canonical_name) <> ''")
    return rows.groupBy(F.lower(F.trim("canonical_name")).alias("signature")).agg(F.min("id").alias("id"))


@catalog.query(
    "SELECT user_id, count(*) AS used, count(*) FILTER (event_type = 'purchase') AS injected, count(*) FILTER (event_type IS DISTINCT FROM 'purchase') AS retrieved, max(ts) AS last_used_at FROM events GROUP BY 1"
)
def usage_statistics(spark, sf_dir):
    return C.usage(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "purchase")


@catalog.query(
    f"""WITH {MEMORY_SQL}, d AS (SELECT src, dst, relationship_name, 0.1 * (count(*) - 1) AS delta FROM memory_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND relationship_name IS NOT NULL GROUP BY 1, 2, 3)
SELECT src, dst, relationship_name, round(1.0 + delta, 6)::DOUBLE AS weight FROM d"""
)
def feedback_weights(spark, sf_dir):
    """Edges weighted up by each further delivery."""
    keys = ["src", "dst", "relationship_name"]
    rows = table(spark, sf_dir, "memory_edges").select(*keys).dropna()
    edges = rows.distinct().withColumn("weight", F.lit(0.9))
    out = C.add_weights(edges, rows.withColumn("delta", F.lit(0.1)), keys)
    return out.withColumn("weight", F.round("weight", 6))


_CHECKS_SQL = """[CASE WHEN NOT coalesce(trim(node_name) <> '', false) THEN 'ERROR:key' END, CASE WHEN NOT coalesce(updated_at >= created_at, false) THEN 'ERROR:version' END,
CASE WHEN NOT coalesce(status IN ('active', 'deprecated', 'superseded'), false) THEN 'WARNING:status' END, CASE WHEN NOT coalesce(len(aliases) > 0, false) THEN 'ERROR:steps' END,
CASE WHEN NOT coalesce(trim(description) <> '', false) THEN 'ERROR:context' END, CASE WHEN NOT coalesce(length(trim(search_text)) >= 10, false) THEN 'WARNING:search_text' END,
CASE WHEN NOT coalesce(regexp_matches(description, '(?i)when'), false) THEN 'WARNING:when' END, CASE WHEN NOT coalesce(regexp_matches(description, '(?i)why|because'), false) THEN 'WARNING:why' END,
CASE WHEN NOT coalesce(regexp_matches(description, '(?i)only|must|never'), false) THEN 'WARNING:boundary' END, CASE WHEN NOT coalesce(len(list_distinct(aliases)) = len(aliases), false) THEN 'WARNING:step_order' END]"""


@catalog.query(f"""WITH {MEMORY_SQL} SELECT id, array_to_string(list_filter({_CHECKS_SQL}, lambda x: x IS NOT NULL), ' ') AS issues, len(list_filter({_CHECKS_SQL}, lambda x: x LIKE 'ERROR:%')) AS n_errors FROM m WHERE node_type = 'Facet'""")
def contract_issues(spark, sf_dir):
    """What a record lacks to be a valid procedure, facets standing for procedures and aliases for steps."""
    c = F.col
    text = c("description")
    checks = [
        ("ERROR", "key", F.trim("node_name") != ""),
        ("ERROR", "version", c("updated_at") >= c("created_at")),
        ("WARNING", "status", c("status").isin("active", "deprecated", "superseded")),
        ("ERROR", "steps", F.size("aliases") > 0),
        ("ERROR", "context", F.trim("description") != ""),
        ("WARNING", "search_text", F.char_length(F.trim("search_text")) >= 10),
        ("WARNING", "when", text.rlike("(?i)when")),
        ("WARNING", "why", text.rlike("(?i)why|because")),
        ("WARNING", "boundary", text.rlike("(?i)only|must|never")),
        ("WARNING", "step_order", F.size(F.array_distinct("aliases")) == F.size("aliases")),
    ]
    found = C.issues(checks)
    errors = F.size(F.filter(found, lambda x: F.startswith(x, F.lit("ERROR:"))))
    return _of(spark, sf_dir, "Facet").select("id", F.array_join(found, " ").alias("issues"), errors.alias("n_errors"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT DISTINCT me.src AS episode, m.id, m.node_name, m.description, m.mentioned_time_start_ms AS s, m.mentioned_time_end_ms AS e, m.mentioned_time_confidence AS c FROM me JOIN m ON m.id = me.dst WHERE relationship_name = 'has_facet'),
n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY id) AS n, count(*) OVER (PARTITION BY episode) AS total FROM f), p AS (SELECT *, ((n - 1) // 2)::INT AS part FROM n WHERE total > 2)
SELECT episode, part, min(ROW(n, node_name))[2] AS title, string_agg('【' || coalesce(node_name, '') || '】' || coalesce(description, ''), '' ORDER BY n) AS summary, count(*) AS n_facets, min(s) AS start_ms, max(e) AS end_ms, round(avg(c), 6) AS confidence FROM p GROUP BY 1, 2"""
)
def episode_splits(spark, sf_dir):
    """Episodes of more than two facets, parted by twos."""
    names = {"node_name": "name", "mentioned_time_start_ms": "start_ms", "mentioned_time_end_ms": "end_ms", "mentioned_time_confidence": "confidence"}
    nodes = memory_nodes(spark, sf_dir).select("id", "description", *(F.col(a).alias(b) for a, b in names.items()))
    return C.split_episodes(_links(spark, sf_dir, "has_facet", "episode", "id").join(nodes, "id"), 2)


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT src AS episode, count(DISTINCT dst) AS n, list(right('0' || dst, 1)) AS d FROM (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'has_facet') GROUP BY 1),
i AS (SELECT episode, n, unnest(list_transform(d, lambda v: instr('0123456789abcdef', v) - 1)) AS i FROM x)
SELECT episode, count(DISTINCT i) = max(n) AS complete, count(DISTINCT i) = count(*) AS different, bool_and(i >= 0 AND i < n) AS in_range, least(max(n) + 5, 50) AS threshold FROM i GROUP BY episode"""
)
def split_checks(spark, sf_dir):
    """Whether made-up assignments (the last digit of each facet's id) part an episode's facets, and its next threshold."""
    x = _links(spark, sf_dir, "has_facet", "episode", "facet")
    digit = F.instr(F.lit("0123456789abcdef"), F.right("facet", F.lit(1))) - 1
    splits = x.groupBy("episode").agg(F.count("*").alias("n"), F.collect_list(digit).alias("indices"))
    checked = C.splits_valid(splits, "episode")
    return checked.join(splits.select("episode", C.adapted_threshold(F.col("n")).alias("threshold")), "episode")


_SCORE, _KIND = rules.procedural_sql("text")


@catalog.query(
    f"""WITH {MEMORY_SQL}, e AS (SELECT id, summary AS text FROM m WHERE node_type = 'Episode' AND summary IS NOT NULL), s AS (SELECT id, text, {_SCORE} AS score FROM e)
SELECT id AS src, 'Procedure:' || id AS dst, 'derived_procedure' AS relationship_name FROM s WHERE {_KIND} IN ('procedural', 'likely')"""
)
def derived_procedures(spark, sf_dir):
    """Edges from episodes whose summary holds a procedure to that procedure."""
    text = F.col("text")
    rows = _of(spark, sf_dir, "Episode", F.col("summary").alias("text")).where("text is not null").withColumn("score", rules.procedural_score(text))
    kept = rows.where(rules.procedural_kind(text, F.col("score")).isin("procedural", "likely"))
    return kept.select(F.col("id").alias("src"), F.concat(F.lit("Procedure:"), "id").alias("dst"), F.lit("derived_procedure").alias("relationship_name"))


@catalog.query(
    r"""WITH x AS (SELECT doc_id, text AS t, instr(lower(text), 'index') AS place FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, t, greatest(place - 40, 1) AS b FROM x WHERE place > 0),
z AS (SELECT doc_id, CASE WHEN b > 1 THEN regexp_replace(substr(t, b, 85), '^[^\s,;.，；。]{0,20}[\s,;.，；。]+', '') ELSE substr(t, b, 85) END AS s FROM y)
SELECT doc_id, trim(regexp_replace(regexp_extract(s, '^([^.!?。！？]*[.!?。！？]?)', 1), '\s+', ' ', 'g')) AS snippet FROM z"""
)
def snippets(spark, sf_dir):
    """Where texts speak of an index."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", C.snippet(F.col("text"), F.lit("index")).alias("snippet")).where("snippet is not null")


@catalog.query(
    f"""WITH {_SECTIONS}, named AS (SELECT s.doc_id, s.pos, coalesce(s.heading, d.title, 'text') AS heading, trim(s.body) AS body FROM sections s JOIN documents d USING (doc_id) WHERE trim(d.text) <> ''),
f AS (SELECT doc_id, heading, body, {_norm('heading')} AS key FROM named QUALIFY row_number() OVER (PARTITION BY doc_id, {_norm('heading')} ORDER BY pos) = 1), g AS (SELECT * FROM f WHERE key <> ''),
p AS (SELECT DISTINCT doc_id, key, {_norm('point')} AS point FROM (SELECT doc_id, key, trim(unnest(regexp_split_to_array(regexp_replace(body, '([.!?。！？]) +', '\\1' || chr(10), 'g'), '[\n；;]'))) AS point FROM g WHERE trim(body) <> '') WHERE {_norm('point')} <> '')
SELECT 'Episode' AS node_type, count(*) AS n FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'Facet', count(*) FROM g UNION ALL SELECT 'FacetPoint', count(*) FROM p"""
)
def written_episodes(spark, sf_dir):
    """How many nodes of each type the documents give."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "text")
    return C.write_episodes(docs)[0].groupBy("node_type").agg(F.count("*").alias("n"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
