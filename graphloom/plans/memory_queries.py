"""Queries over the memory graph and over texts: upserts, merges, rules, chunks, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunking, evaluation, memory
from graphloom.operators import retrieval as R
from graphloom.plans.catalog import MEMORY_SQL, Catalog
from graphloom.plans.retrieval_queries import BM25_SQL
from graphloom.sources.graph_tables import code_nodes, memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT src, count(*) AS n FROM (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'has_facet') GROUP BY src)
SELECT m.id, m.node_name, coalesce(n, 0) AS n_facets FROM m LEFT JOIN f ON f.src = m.id WHERE m.node_type = 'Episode'"""
)
def facets_per_episode(spark, sf_dir):
    facets = memory_edges(spark, sf_dir, "has_facet").select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_facets"))
    episodes = memory_nodes(spark, sf_dir).where("node_type = 'Episode'").select("id", "node_name")
    return episodes.join(facets, "id", "left").fillna(0, ["n_facets"])


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT coalesce(nullif(trim(edge_text), ''), relationship_name) AS label, count(*) AS number_of_edges FROM me GROUP BY 1"""
)
def relation_index(spark, sf_dir):
    label = F.coalesce(F.nullif(F.trim("edge_text"), F.lit("")), F.col("relationship_name"))
    return memory_edges(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("number_of_edges"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, k AS (SELECT id, coalesce(summary, search_text, description, node_name, '') AS text FROM m)
SELECT me.src, me.dst, relationship_name, array_to_string(list_filter([nullif(a.text, ''), coalesce(nullif(trim(edge_text), ''), relationship_name), nullif(b.text, '')], lambda x: x IS NOT NULL), ' -> ') AS text
FROM me JOIN k a ON a.id = me.src JOIN k b ON b.id = me.dst"""
)
def triplet_texts(spark, sf_dir):
    nodes = memory_nodes(spark, sf_dir).select("id", F.coalesce("summary", "search_text", "description", "node_name", F.lit("")).alias("text"))
    return memory.triplets(nodes, memory_edges(spark, sf_dir))


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT id, node_type || '_' || field AS collection, text FROM (
SELECT id, node_type, 'summary' AS field, summary AS text FROM m UNION ALL SELECT id, node_type, 'search_text', search_text FROM m UNION ALL SELECT id, node_type, 'canonical_name', canonical_name FROM m) WHERE text IS NOT NULL"""
)
def vector_collections(spark, sf_dir):
    """One row per node and indexed field that isn't null, by collection."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("summary", "search_text", "canonical_name")])
    rows = memory_nodes(spark, sf_dir).select("id", "node_type", F.explode(fields).alias("f")).where("f.text is not null")
    return rows.select("id", F.concat_ws("_", "node_type", "f.field").alias("collection"), F.col("f.text").alias("text"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, x AS (SELECT id, lower(trim(canonical_name)) AS c FROM m WHERE node_type = 'Entity' AND trim(canonical_name) <> ''),
g AS (SELECT c, min(id) AS first, count(*) AS n FROM x GROUP BY c) SELECT x.id, g.first AS same_as FROM x JOIN g USING (c) WHERE g.n > 1 AND x.id <> g.first"""
)
def same_entity_edges(spark, sf_dir):
    """Entities of one canonical name, each linked to the first of them."""
    x = memory_nodes(spark, sf_dir).where("node_type = 'Entity' and trim(canonical_name) <> ''").select("id", F.lower(F.trim("canonical_name")).alias("c"))
    g = x.groupBy("c").agg(F.min("id").alias("same_as"), F.count("*").alias("n")).where("n > 1")
    return x.join(g, "c").where("id <> same_as").select("id", "same_as")


@catalog.query(
    f"""WITH {MEMORY_SQL}, n AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
e AS (SELECT id, coalesce(canonical_name, node_name) AS name FROM m WHERE node_type = 'Entity' AND coalesce(canonical_name, node_name) <> ''),
c AS (SELECT id, node_name, fqn FROM n WHERE node_name IS NOT NULL) SELECT DISTINCT e.id AS entity, c.id AS code FROM e JOIN c ON c.node_name = e.name OR list_last(string_split(c.fqn, '.')) = e.name"""
)
def link_concepts_and_code(spark, sf_dir):
    """Entities whose name is a code node's name or the last part of its full name; two equi-joins instead of a suffix test of all pairs."""
    entities = memory_nodes(spark, sf_dir).where("node_type = 'Entity'").select(F.col("id").alias("entity"), F.coalesce("canonical_name", "node_name").alias("name"))
    entities = entities.where("name <> ''")
    code = code_nodes(spark, sf_dir, "node_name", "fqn").where("node_name is not null")
    names = code.select(F.col("id").alias("code"), F.explode(F.array("node_name", F.element_at(F.split("fqn", r"\."), -1))).alias("name"))
    return entities.join(names, "name").select("entity", "code").distinct()


@catalog.query(
    f"""WITH {MEMORY_SQL}, r AS (SELECT dataset_id, mentioned_time_start_ms AS s, mentioned_time_end_ms AS e, coalesce(mentioned_time_confidence, 0.7) AS c FROM m
WHERE mentioned_time_start_ms <= mentioned_time_end_ms) SELECT dataset_id, min(s) AS start_ms, max(e) AS end_ms, round(sum(c * greatest(e - s, 1)) / sum(greatest(e - s, 1)), 6) AS confidence FROM r GROUP BY 1"""
)
def merged_times(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).select(
        "dataset_id",
        F.col("mentioned_time_start_ms").alias("start_ms"),
        F.col("mentioned_time_end_ms").alias("end_ms"),
        F.col("mentioned_time_confidence").alias("confidence"),
    )
    return memory.merge_times(rows, "dataset_id").withColumn("confidence", F.round("confidence", 6))


@catalog.query(
    f"""WITH {MEMORY_SQL}, u AS (SELECT src AS id FROM me UNION SELECT dst FROM me) SELECT id, node_type FROM m WHERE id NOT IN (SELECT id FROM u WHERE id IS NOT NULL)"""
)
def isolated_nodes(spark, sf_dir):
    edges = memory_edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return memory_nodes(spark, sf_dir).select("id", "node_type").join(ends, "id", "left_anti")


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT DISTINCT src, dst, relationship_name FROM me WHERE src NOT IN (SELECT id FROM m WHERE status = 'deprecated') AND dst NOT IN (SELECT id FROM m WHERE status = 'deprecated')"""
)
def detach_delete(spark, sf_dir):
    """The edges that remain when all deprecated nodes are deleted."""
    nodes = memory_nodes(spark, sf_dir)
    gone = nodes.where("status = 'deprecated'").select("id")
    return memory.delete_nodes(nodes, memory_edges(spark, sf_dir), gone)[1].select("src", "dst", "relationship_name").distinct()


@catalog.query(
    """WITH a AS (SELECT id, node_name, status, updated_at FROM memory_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS FIRST, created_at) = 1),
b AS (SELECT id, status FROM memory_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC) = 1)
SELECT a.id, a.node_name, coalesce(b.status, a.status) AS status FROM a JOIN b USING (id)"""
)
def upsert_nodes(spark, sf_dir):
    """The first delivery of each node updated by its last one: values that are null keep the old ones."""
    rows = table(spark, sf_dir, "memory_nodes")
    old = memory.first_wins(rows, ["id"], [F.asc_nulls_first("updated_at"), F.col("created_at")]).select("id", "node_name", "status")
    new = memory.first_wins(rows, ["id"], [F.desc_nulls_last("updated_at"), F.desc("created_at")]).select("id", "status")
    return memory.upsert_nodes(old, new)


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT id, array_to_string(list_filter([nullif(trim(node_name), ''), nullif(trim(description), ''), nullif(trim(canonical_name), '')], lambda x: x IS NOT NULL), ' | ') AS edge_text FROM m WHERE node_type IN ('Entity', 'Facet')"""
)
def edge_text_template(spark, sf_dir):
    rows = memory_nodes(spark, sf_dir).where("node_type in ('Entity', 'Facet')")
    return rows.select("id", memory.bar_text(F.col("node_name"), F.col("description"), F.col("canonical_name")).alias("edge_text"))


# -- text rules -----------------------------------------------------------------------
def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "title")


@catalog.query(
    r"""WITH t AS (SELECT doc_id, trim(coalesce(title, '')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 'CRITICAL:empty' WHEN length(t) < 2 THEN 'CRITICAL:short'
WHEN regexp_matches(t, '^[0-9]+$') THEN 'CRITICAL:digits' WHEN regexp_matches(t, '^[^\p{L}\p{N}]+$') THEN 'CRITICAL:punctuation'
WHEN regexp_matches(lower(t), '^(the|this|it|there)\s') THEN 'WARNING:prefix' WHEN lower(t) IN ('summary', 'details', 'information', 'content', 'topic') THEN 'WARNING:generic' ELSE 'GOOD' END AS verdict FROM t"""
)
def search_text_quality(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.search_text_quality(F.col("title")).alias("verdict"))


@catalog.query(
    rf"""WITH w AS (SELECT doc_id, lower(translate(text, '{T.WIDE}', '{T.NARROW}')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS compare_key, regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g') AS id_key FROM w"""
)
def normalised_texts(spark, sf_dir):
    rows = _texts(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", T.normalize_for_compare(F.col("text")).alias("compare_key"), T.normalize_for_id(F.col("text")).alias("id_key"))


@catalog.query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, round((length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g'))) / nullif(length(t), 0)::DOUBLE, 6) AS ratio FROM s"""
)
def han_ratio(spark, sf_dir):
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", F.round(T.han_ratio(F.col("text")), 6).alias("ratio"))


@catalog.query("SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 59)) || '…' ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def truncated(spark, sf_dir):
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", T.truncate(F.col("text"), 60).alias("short"))


@catalog.query(
    r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '([a-z]{2,})', 1))) AS n_latin, len(regexp_extract_all(text, '\b([a-z]+(?:_[a-z]+)+)\b', 1)) AS n_snake FROM documents WHERE text IS NOT NULL"""
)
def anchor_counts(spark, sf_dir):
    rows = _texts(spark, sf_dir).where("text is not null")
    snake = F.size(F.regexp_extract_all("text", F.lit(r"\b([a-z]+(?:_[a-z]+)+)\b"), 1))
    return rows.select("doc_id", F.size(T.latin_words(F.col("text"))).alias("n_latin"), snake.alias("n_snake"))


@catalog.query(
    r"""SELECT doc_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?\s?(?:%|percent|ms|seconds|days|megabytes))', 1), regexp_extract_all(text, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)),
list_concat(regexp_extract_all(text, '\b([a-z]+(?:_[a-z]+)+)\b', 1), regexp_extract_all(text, '\b([A-Z]{2,})\b', 1))))) AS anchor FROM documents WHERE text IS NOT NULL"""
)
def text_anchors(spark, sf_dir):
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", F.explode(T.anchors(F.col("text"))).alias("anchor"))


# -- chunks, clusters, evaluation ---------------------------------------------------------
@catalog.query()
def text_chunks(spark, sf_dir):
    return chunking.chunk(_texts(spark, sf_dir), id_col="doc_id", text_col="text", max_words=80)


@catalog.query()
def overlapping_chunks(spark, sf_dir):
    return chunking.chunk(_texts(spark, sf_dir), id_col="doc_id", text_col="text", max_words=80, overlap=0.2)


@catalog.query()
def row_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lower(doc_type) = 'csv'")
    return chunking.chunk(rows, id_col="doc_id", text_col="text", max_words=40, rows=True)


@catalog.query()
def text_sentences(spark, sf_dir):
    return chunking.sentence_rows(_texts(spark, sf_dir), id_col="doc_id", text_col="text")


@catalog.query()
def code_chunks(spark, sf_dir):
    return chunking.code_chunk_rows(table(spark, sf_dir, "source_files"))


@catalog.query("SELECT doc_id AS document_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS token_count FROM documents WHERE trim(text) <> '' AND len(regexp_extract_all(text, '\\S+')) > 0")
def token_counts(spark, sf_dir):
    """The sizes of a document's chunks, added up: every word is in exactly one chunk."""
    return text_chunks(spark, sf_dir).groupBy("document_id").agg(F.sum("chunk_size").alias("token_count"))


@catalog.query()
def semantic_dedup(spark, sf_dir):
    """Greedy clusters of similar vectors among all of one label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return memory.greedy_clusters(rows, "label")


_GRAMS = "list_distinct(list_transform(range(greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' ')))"
_TOKEN_LIST = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1)"


@catalog.query(
    f"""WITH d AS (SELECT doc_id, {_TOKEN_LIST.format('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, item_kind, {_TOKEN_LIST.format('item_text')} AS w FROM eval_items),
dg AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d), ig AS (SELECT item_id, item_kind, len({_GRAMS}) AS n, unnest({_GRAMS}) AS g FROM i),
x AS (SELECT item_id, item_kind, doc_id FROM ig JOIN dg USING (g) GROUP BY item_id, item_kind, n, doc_id HAVING count(*) >= 0.5 * n), {BM25_SQL},
b AS (SELECT x.item_id, item_kind, min(r.rank) AS best FROM x LEFT JOIN ranked r ON r.query_id = x.item_id AND r.doc_id = x.doc_id AND r.rank <= 3 GROUP BY 1, 2)
SELECT item_kind AS type, count(*) AS n, round(avg((coalesce(best, 99) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce(best, 99) <= 2)::INT), 6) AS recall_at_2, round(avg((coalesce(best, 99) <= 3)::INT), 6) AS recall_at_3 FROM b GROUP BY ROLLUP (item_kind)"""
)
def retrieval_recall(spark, sf_dir):
    """How often lexical search finds a document that holds a test item: half of the item's runs of five words, by kind and overall."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("text"), F.col("item_kind").alias("type"))
    words = T.tokens(F.col("text"))
    runs = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda k: F.array_join(F.slice("w", k, 5), " ")))
    held = documents.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("g"))
    asked = items.select("query_id", "type", words.alias("w")).select("query_id", "type", F.array_distinct(runs).alias("all"))
    asked = asked.select("query_id", "type", F.size("all").alias("n"), F.explode("all").alias("g"))
    shared = asked.join(held, "g").groupBy("query_id", "type", "n", "doc_id").agg(F.count("*").alias("k")).where("k >= 0.5 * n")
    expected = shared.select("query_id", "type", F.col("doc_id").alias("id"))
    found = R.top_k(R.bm25(documents, items), ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], 3)
    return evaluation.recall_at(found.select("query_id", F.col("doc_id").alias("id"), "rank"), expected)


QUERIES, ORACLE = catalog.queries, catalog.oracle
