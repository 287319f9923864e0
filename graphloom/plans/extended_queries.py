"""Further queries: code search, slices, settings as nodes, recall decisions, reports, dialogues, times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import timeparse
from graphloom.functions.text import STOP_WORDS
from graphloom.operators import retrieval as R
from graphloom.operators import traversal
from graphloom.plans.catalog import EDGES_SQL, MEMORY_SQL, NODES_SQL, Catalog
from graphloom.sources.graph_tables import code_edges, code_nodes, memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()
_FN = "('function_definition','method_declaration','method_definition')"


_SEARCH_WORDS = f"list_filter(regexp_extract_all(lower(t), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: x NOT IN ({', '.join(chr(39) + w + chr(39) for w in STOP_WORDS)}))"


@catalog.query(
    f"""WITH {NODES_SQL}, d AS (SELECT id, concat_ws(' ', node_name, fqn, source_code) AS t FROM n WHERE node_type IN {_FN[:-1]}, 'class_definition')), w AS (SELECT id, {_SEARCH_WORDS} AS words FROM d),
f AS (SELECT id, words, len(words) AS n FROM w WHERE len(words) > 0), z AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM f), p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(words) AS term FROM f) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q(query_id, term) AS (VALUES (1, 'ledger_page'), (2, 'measure'), (2, 'registry'), (3, 'resolver')),
s AS (SELECT query_id, id AS doc_id, sum(greatest(1e-5, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN df USING (term) JOIN p USING (term) CROSS JOIN z GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""
)
def search_code(spark, sf_dir):
    """BM25 over name, full name and source of functions and classes, for a fixed set of three searches."""
    rows = code_nodes(spark, sf_dir, "node_type", "node_name", "fqn", "source_code").where(f"node_type in {_FN[:-1]}, 'class_definition')")
    docs = rows.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "node_name", "fqn", "source_code").alias("text"))
    asked = spark.createDataFrame([(1, "ledger_page"), (2, "measure registry"), (3, "resolver")], "query_id long, text string")
    return R.top_k(R.bm25(docs, asked), ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], 10).withColumn("score", F.round("score", 6))


@catalog.query(
    f"""WITH {NODES_SQL}, x AS (SELECT file_path, line, id, code, row_number() OVER (PARTITION BY file_path, line ORDER BY id) AS r FROM n WHERE line IS NOT NULL AND trim(code) <> '')
SELECT file_path, count(*) AS n_lines, md5(string_agg(line || ': ' || code, chr(10) ORDER BY line)) AS rendering FROM x WHERE r = 1 GROUP BY file_path"""
)
def render_slice(spark, sf_dir):
    """Per file the first node of each line with code, in the order of lines, as one text (here its digest)."""
    rows = code_nodes(spark, sf_dir, "file_path", "line", "code").where("line is not null and trim(code) <> ''")
    first = rows.groupBy("file_path", "line").agg(F.min(F.struct("id", "code")).alias("f"))
    lines = F.array_sort(F.collect_list(F.struct("line", F.concat(F.col("line").cast("string"), F.lit(": "), F.col("f.code")).alias("t"))))
    text = F.array_join(F.transform(lines, lambda x: x.t), "\n")
    return first.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.md5(text).alias("rendering"))


@catalog.query(
    f"""WITH {EDGES_SQL}, s AS (SELECT id FROM n WHERE is_source), k AS (SELECT id FROM s UNION SELECT dst FROM e WHERE src IN (SELECT id FROM s) AND edge_type = 'CALLS'
UNION SELECT src FROM e WHERE dst IN (SELECT id FROM s) AND edge_type = 'CALLS') SELECT src, dst, edge_type FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) AND edge_type <> 'PARENT_OF'"""
)
def induced_subgraph(spark, sf_dir):
    """All edges but those of the tree between sources and what calls them or is called."""
    edges = code_edges(spark, sf_dir)
    seeds = code_nodes(spark, sf_dir, "is_source").where("is_source").select("id")
    calls = edges.where("edge_type = 'CALLS'")
    out = calls.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = calls.join(seeds.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    kept = seeds.union(out).union(back).distinct()
    inner = edges.where("edge_type <> 'PARENT_OF'")
    for end in ("src", "dst"):
        inner = inner.join(kept.withColumnRenamed("id", end), end, "left_semi")
    return inner.select("src", "dst", "edge_type")


@catalog.query(
    r"""WITH l AS (SELECT DISTINCT file_path, unnest(string_split(code, chr(10))) AS line FROM source_files WHERE file_path LIKE '%.properties' AND code IS NOT NULL),
x AS (SELECT file_path, trim(regexp_extract(line, '^\s*([^#!\s=:][^=:]*)[=:]', 1)) AS key, trim(regexp_extract(line, '^\s*[^#!\s=:][^=:]*[=:](.*)$', 1), ' ' || chr(13) || chr(9)) AS value FROM l)
SELECT DISTINCT file_path, key, value FROM x WHERE key <> ''"""
)
def property_nodes(spark, sf_dir):
    """Settings as key-value nodes, parted at the first equals sign or colon."""
    rows = table(spark, sf_dir, "source_files").where(F.col("file_path").endswith(".properties") & F.col("code").isNotNull())
    lines = rows.select("file_path", F.explode(F.split("code", "\n")).alias("line"))
    key = F.trim(F.regexp_extract("line", r"^\s*([^#!\s=:][^=:]*)[=:]", 1))
    value = F.btrim(F.regexp_extract("line", r"^\s*[^#!\s=:][^=:]*[=:]([^\n]*)$", 1), F.lit(" \r\t"))
    return lines.select("file_path", key.alias("key"), value.alias("value")).where("key <> ''").distinct()


@catalog.query(
    """WITH t AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(code, '<property name="[^"]*" value="[^"]*"/>')) AS tag FROM source_files WHERE file_path LIKE '%.xml' AND code IS NOT NULL)
SELECT DISTINCT file_path, regexp_extract(tag, 'name="([^"]*)"', 1) AS key, regexp_extract(tag, 'value="([^"]*)"', 1) AS value FROM t"""
)
def xml_nodes(spark, sf_dir):
    """Named properties of XML settings as nodes."""
    rows = table(spark, sf_dir, "source_files").where(F.col("file_path").endswith(".xml") & F.col("code").isNotNull())
    pairs = F.regexp_extract_all("code", F.lit(r'<property name="[^"]*" value="[^"]*"/>'), 0)
    tags = rows.select("file_path", F.explode(pairs).alias("tag"))
    return tags.select("file_path", F.regexp_extract("tag", 'name="([^"]*)"', 1).alias("key"), F.regexp_extract("tag", 'value="([^"]*)"', 1).alias("value")).distinct()


@catalog.query(
    f"""WITH {MEMORY_SQL}, c AS (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'involves_entity'), k AS (SELECT dst, count(*) AS n FROM c GROUP BY dst)
SELECT c.src AS holder, c.dst AS entity FROM c JOIN k ON k.dst = c.dst WHERE n = 1"""
)
def exclusive_entities(spark, sf_dir):
    """Entities that one holder alone contains: what would be orphaned with it."""
    links = memory_edges(spark, sf_dir, "involves_entity").select(F.col("src").alias("holder"), F.col("dst").alias("entity")).distinct()
    alone = links.groupBy("entity").agg(F.count("*").alias("n")).where("n = 1")
    return links.join(alone, "entity", "left_semi").select("holder", "entity")


@catalog.query(
    f"""WITH {MEMORY_SQL} SELECT me.src AS id, relationship_name, m.node_type AS other_type, count(*) AS n FROM me JOIN m ON m.id = me.dst GROUP BY 1, 2, 3"""
)
def entity_network(spark, sf_dir):
    """Neighbours of each node counted by relation and type."""
    kinds = memory_nodes(spark, sf_dir).select(F.col("id").alias("dst"), F.col("node_type").alias("other_type"))
    return memory_edges(spark, sf_dir).join(kinds, "dst").groupBy(F.col("src").alias("id"), "relationship_name", "other_type").agg(F.count("*").alias("n"))


@catalog.query(
    f"""WITH {MEMORY_SQL}, f AS (SELECT m.id, m.node_name, count(x.dst) AS n FROM m LEFT JOIN (SELECT DISTINCT src, dst FROM me WHERE relationship_name = 'has_facet') x ON x.src = m.id WHERE m.node_type = 'Episode' GROUP BY 1, 2)
SELECT id, node_name, n AS n_facets, CASE WHEN n = 0 THEN 'empty' WHEN n >= 10 THEN 'critical' WHEN n >= 5 THEN 'oversized' ELSE 'fine' END AS state FROM f"""
)
def episode_quality(spark, sf_dir):
    facets = memory_edges(spark, sf_dir, "has_facet").select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    rows = memory_nodes(spark, sf_dir).where("node_type = 'Episode'").select("id", "node_name").join(facets, "id", "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 0, "empty").when(n >= 10, "critical").when(n >= 5, "oversized").otherwise("fine")
    return rows.select("id", "node_name", n.alias("n_facets"), state.alias("state"))


@catalog.query(
    """WITH x AS (SELECT label, vec_id, (vec_id * 7919 % 1000) / 1000.0 AS d FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k,
lead(d) OVER (PARTITION BY label ORDER BY d, vec_id) AS next FROM x)
SELECT label, vec_id, k FROM (SELECT *, max(CASE WHEN k = 1 THEN d END) OVER (PARTITION BY label) AS d1 FROM r) WHERE k = 1 AND d < 0.25 OR k = 2 AND d1 < 0.25 AND d - d1 < 0.1"""
)
def injection_decision(spark, sf_dir):
    """Without a trigger the best hit is used only if it is near, the second only if it is as near within a gap."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("d"))
    ranked = R.top_k(rows, ["label"], [F.col("d"), F.col("vec_id")], 2, "k")
    d1 = F.max(F.when(F.col("k") == 1, F.col("d"))).over(Window.partitionBy("label"))
    return ranked.withColumn("d1", d1).where("(k = 1 and d < 0.25) or (k = 2 and d1 < 0.25 and d - d1 < 0.1)").select("label", "vec_id", "k")


@catalog.query(
    """SELECT label, vec_id, round((d - min(d) OVER w) / nullif(max(d) OVER w - min(d) OVER w, 0), 6) AS normal FROM (SELECT label, vec_id, (vec_id * 7919 % 1000) / 1000.0 AS d FROM embeddings) WINDOW w AS (PARTITION BY label)"""
)
def normalised_distances(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("d"))
    return R.minmax(rows, "label", "d").select("label", "vec_id", F.round("normal", 6).alias("normal"))


@catalog.query(
    """WITH h AS (SELECT user_id, event_type, value, event_id FROM events WHERE value IS NOT NULL) SELECT user_id, min(value) AS best, arg_min(event_type, (value, event_id)) AS kind,
string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM h GROUP BY user_id"""
)
def best_version(spark, sf_dir):
    """Per key the lowest score, what had it, and the union of kinds."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    best = F.min(F.struct("value", "event_id", "event_type"))
    return rows.groupBy("user_id").agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")).select(
        "user_id", F.col("b.value").alias("best"), F.col("b.event_type").alias("kind"), "kinds"
    )


@catalog.query(
    r"""WITH c AS (SELECT event_id, user_id, value, regexp_replace(lower(event_type), '[^\p{L}\p{N}]+', '', 'g') AS key FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY value DESC, event_id) AS k FROM c WHERE key <> '')
SELECT event_id, user_id, key FROM r WHERE k = 1"""
)
def candidate_dedup(spark, sf_dir):
    """Of candidates with one normal form the most confident one."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", T.normalize_for_id(F.col("event_type")).alias("key")).where("key <> ''")
    return R.top_k(rows, ["user_id", "key"], [F.desc("value"), F.col("event_id")], 1).select("event_id", "user_id", "key")


@catalog.query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, regexp_extract(line, '^\s*([A-Za-z][A-Za-z0-9_]{0,20}):\s+\S', 1) AS speaker FROM l WHERE trim(line) <> ''),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE speaker <> '') AS spoken, count(DISTINCT nullif(speaker, '')) AS speakers FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_lines, speakers FROM c WHERE n >= 4 AND spoken >= 0.35 * n AND speakers >= 2 AND spoken > speakers"""
)
def dialogues(spark, sf_dir):
    """Texts of which a share of lines are spoken by at least two speakers, one of them repeatedly."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    speaker = F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z0-9_]{0,20}):\s+\S", 1)
    counts = rows.select("doc_id", F.nullif(speaker, F.lit("")).alias("speaker")).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count("speaker").alias("spoken"), F.countDistinct("speaker").alias("speakers")
    )
    return counts.where("n_lines >= 4 and spoken >= 0.35 * n_lines and speakers >= 2 and spoken > speakers").select("doc_id", "n_lines", "speakers")


@catalog.query(
    r"""SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9]+(?:\.[0-9]+)?\s?(?:%|percent|ms|seconds|minutes|hours|days|megabytes)'))) AS number FROM documents WHERE text IS NOT NULL"""
)
def number_tokens(spark, sf_dir):
    """Distinct numbers with their units."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[0-9]+(?:\.[0-9]+)?\s?(?:%|percent|ms|seconds|minutes|hours|days|megabytes)"), 0)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(found)).alias("number"))


@catalog.query(
    """WITH t AS (SELECT DISTINCT doc_id AS id, created_at::DATE AS d, doc_id % 5 AS k FROM documents WHERE created_at IS NOT NULL),
r AS (SELECT id, CASE WHEN k < 2 THEN d WHEN k = 2 THEN date_trunc('month', d) WHEN k = 3 THEN date_trunc('quarter', d) ELSE date_trunc('year', d) END AS a,
CASE WHEN k < 2 THEN d + INTERVAL 1 DAY WHEN k = 2 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN k = 3 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH ELSE date_trunc('year', d) + INTERVAL 1 YEAR END AS b, CASE WHEN k < 2 THEN 0.9 WHEN k < 4 THEN 0.8 ELSE 0.75 END AS confidence FROM t)
SELECT id, epoch_ms(a::TIMESTAMP) AS start_ms, epoch_ms(b::TIMESTAMP) AS end_ms, confidence::DOUBLE AS confidence FROM r"""
)
def mentioned_times(spark, sf_dir):
    """The times that notes mention; the notes are written from the dates of documents in five ways."""
    d, k = F.to_date("created_at"), F.col("doc_id") % 5
    month = F.date_format(d, "MMMM")
    note = (
        F.when(k == 0, F.concat(F.lit("Written on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" by hand.")))
        .when(k == 1, F.concat(F.lit("Seen "), month, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string")))
        .when(k == 2, F.concat(F.lit("A change in "), month, F.lit(" "), F.year(d).cast("string")))
        .when(k == 3, F.concat(F.lit("Due Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")))
        .otherwise(F.concat(F.lit("Open since "), F.year(d).cast("string")))
    )
    notes = table(spark, sf_dir, "documents").where("created_at is not null").select("doc_id", note.alias("note")).distinct()
    return timeparse.mentioned_times(notes, id_col="doc_id", text_col="note", now_ms=1_750_000_000_000).select("id", "start_ms", "end_ms", "confidence")


@catalog.query(
    f"""WITH {EDGES_SQL}, c AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM e WHERE edge_type = 'CALLS'), p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM e WHERE edge_type = 'PARENT_OF')
SELECT c.dst AS argument, p.dst AS parameter FROM c JOIN p ON p.src = c.src AND p.pos = c.pos"""
)
def positional_join(spark, sf_dir):
    """The i-th of one list with the i-th of another, as arguments with parameters."""
    w = Window.partitionBy("src").orderBy("dst")
    edges = code_edges(spark, sf_dir, "CALLS", "PARENT_OF")
    a = edges.where("edge_type = 'CALLS'").select("src", F.col("dst").alias("argument"), F.row_number().over(w).alias("pos"))
    b = edges.where("edge_type = 'PARENT_OF'").select("src", F.col("dst").alias("parameter"), F.row_number().over(w).alias("pos"))
    return a.join(b, ["src", "pos"]).select("argument", "parameter")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, i0 AS (SELECT src, dst FROM e WHERE edge_type = 'IMPLEMENTS'), i AS (SELECT src AS child, dst AS parent FROM i0 UNION SELECT i.child, i0.dst FROM i JOIN i0 ON i0.src = i.parent), c AS (SELECT src AS owner, dst AS method FROM e WHERE edge_type = 'PARENT_OF'),
m AS (SELECT c.owner, c.method, n.node_name FROM c JOIN n ON n.id = c.method), k AS (SELECT src, dst FROM e WHERE edge_type = 'CALLS')
SELECT DISTINCT k.src, o.method AS dst FROM k JOIN m b ON b.method = k.dst JOIN i ON i.parent = b.owner JOIN m o ON o.owner = i.child AND o.node_name = b.node_name"""
)
def polymorphic_calls(spark, sf_dir):
    """Calls of a method extended to the methods of its name in classes that implement its own over any number of steps."""
    names = code_nodes(spark, sf_dir, "node_name").select(F.col("id").alias("method"), "node_name")
    methods = code_edges(spark, sf_dir, "PARENT_OF").select(F.col("src").alias("owner"), F.col("dst").alias("method")).join(names, "method")
    base = methods.select(F.col("owner").alias("parent"), F.col("method").alias("called"), "node_name")
    over = methods.select(F.col("owner").alias("child"), F.col("method").alias("dst"), "node_name")
    kinds = traversal.transitive_closure(code_edges(spark, sf_dir, "IMPLEMENTS")).select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    calls = code_edges(spark, sf_dir, "CALLS").select("src", F.col("dst").alias("called"))
    return calls.join(base, "called").join(kinds, "parent").join(over, ["child", "node_name"]).select("src", "dst").distinct()


@catalog.query(
    """WITH d AS (SELECT dataset_id, count(*) AS n_documents, count(DISTINCT source) AS n_sources, sum(length(text)) AS n_chars FROM documents GROUP BY 1), m AS (SELECT dataset_id, count(DISTINCT id) AS n_nodes FROM memory_nodes GROUP BY 1)
SELECT coalesce(d.dataset_id, m.dataset_id) AS dataset_id, coalesce(n_documents, 0) AS n_documents, coalesce(n_sources, 0) AS n_sources, coalesce(n_chars, 0) AS n_chars, coalesce(n_nodes, 0) AS n_nodes FROM d FULL JOIN m ON d.dataset_id = m.dataset_id"""
)
def dataset_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("dataset_id").agg(
        F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.sum(F.char_length("text")).alias("n_chars")
    )
    nodes = table(spark, sf_dir, "memory_nodes").groupBy("dataset_id").agg(F.countDistinct("id").alias("n_nodes"))
    return docs.join(nodes, "dataset_id", "full").fillna(0, ["n_documents", "n_sources", "n_chars", "n_nodes"])


QUERIES, ORACLE = catalog.queries, catalog.oracle
