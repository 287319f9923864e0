"""Queries over the code graph: filters, joins, aggregates, traversal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import traversal
from graphloom.operators.components import components
from graphloom.plans.catalog import EDGES_SQL, NODES_SQL, Catalog
from graphloom.sources.graph_tables import code_edges, code_nodes
from graphloom.session import cut_lineage

catalog = Catalog()
_ASKED_NAMES = ("index", "layer", "no such name", "queue", "graph", "index")
_ASKED_SQL = ", ".join(f"({k}, '{n}')" for k, n in enumerate(_ASKED_NAMES))
FUNCTIONS = ("function_definition", "method_declaration", "method_definition")
_FN = "('function_definition','method_declaration','method_definition')"


def _method():
    return F.col("node_type").isin(*FUNCTIONS)



# -- filters and projections ------------------------------------------------------
@catalog.query(f"WITH {NODES_SQL} SELECT id, node_name, fqn, file_path, line FROM n WHERE node_type = 'class_definition' AND lower(node_name) LIKE '%service%'")
def query_nodes(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "node_type", "node_name", "fqn", "file_path", "line")
    return rows.where((F.col("node_type") == "class_definition") & F.lower("node_name").contains("service")).select("id", "node_name", "fqn", "file_path", "line")


@catalog.query(f"WITH {EDGES_SQL} SELECT src, dst FROM e WHERE edge_type = 'DEPENDS_ON'")
def query_edges(spark, sf_dir):
    return code_edges(spark, sf_dir, "DEPENDS_ON").select("src", "dst")


@catalog.query(
    f"""WITH {NODES_SQL}, want(pos, name) AS (VALUES {_ASKED_SQL}) SELECT w.pos, min(n.id) AS id, w.name AS node_name FROM want w JOIN n ON n.node_name = w.name GROUP BY 1, 3"""
)
def nodes_by_ids(spark, sf_dir):
    """Lookup of a list of names, each by its first node; keeps the place in the request and drops missing ones."""
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name")
    asked = spark.createDataFrame(list(enumerate(_ASKED_NAMES)), "pos int, node_name string")
    first = nodes.where("node_name is not null").join(asked, "node_name").groupBy("pos").agg(F.min(F.struct("id", "node_name")).alias("b"))
    return first.select("pos", "b.id", "b.node_name")


@catalog.query(
    f"""WITH {EDGES_SQL} SELECT f.file_path, c.id, c.node_type, c.node_name, c.line_start FROM n f
JOIN e ON e.src = f.id AND e.edge_type = 'CONTAINS' JOIN n c ON c.id = e.dst WHERE f.node_type = 'file'"""
)
def file_structure(spark, sf_dir):
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name", "file_path", "line_start")
    files = nodes.where("node_type = 'file'").select(F.col("id").alias("src"), "file_path")
    parts = nodes.select(F.col("id").alias("dst"), "node_type", "node_name", "line_start")
    links = code_edges(spark, sf_dir, "CONTAINS").select("src", "dst")
    return links.join(files, "src").join(parts, "dst").select("file_path", F.col("dst").alias("id"), "node_type", "node_name", "line_start")


@catalog.query(f"WITH {NODES_SQL} SELECT id, list_extract(list_filter(labels, lambda x: x <> 'Node'), 1) AS label, len(labels) AS n_labels FROM n")
def first_label(spark, sf_dir):
    own = F.get(F.filter("labels", lambda x: x != "Node"), F.lit(0))
    return code_nodes(spark, sf_dir, "labels").select("id", own.alias("label"), F.size("labels").alias("n_labels"))


def enriched_label(node_type):
    """The label that a syntax type adds to a node."""
    pairs = {
        "function_definition": "Function", "method_declaration": "Method", "method_definition": "Method", "class_definition": "Class",
        "call": "CallSite", "identifier": "Identifier", "string": "Literal", "file": "File", "package": "Package", "module": "Module",
    }
    chain = None
    for name, label in pairs.items():
        chain = F.when(node_type == name, label) if chain is None else chain.when(node_type == name, label)
    return chain


@catalog.query(
    f"""WITH {NODES_SQL}, x AS (SELECT id, CASE node_type WHEN 'function_definition' THEN 'Function' WHEN 'method_declaration' THEN 'Method'
WHEN 'method_definition' THEN 'Method' WHEN 'class_definition' THEN 'Class' WHEN 'call' THEN 'CallSite' WHEN 'identifier' THEN 'Identifier'
WHEN 'string' THEN 'Literal' WHEN 'file' THEN 'File' WHEN 'package' THEN 'Package' WHEN 'module' THEN 'Module' END AS label FROM n)
SELECT id, label FROM x WHERE label IS NOT NULL"""
)
def label_enrichment(spark, sf_dir):
    return code_nodes(spark, sf_dir, "node_type").select("id", enriched_label(F.col("node_type")).alias("label")).where("label is not null")


@catalog.query(
    f"""WITH {NODES_SQL} SELECT id, CASE WHEN node_name LIKE '%Service' THEN 'Service' WHEN node_name LIKE '%Builder' OR node_name LIKE '%Planner' THEN 'Factory'
WHEN node_name LIKE '%Router' OR node_name LIKE '%Action' THEN 'Controller' WHEN node_name LIKE '%Model' THEN 'Entity'
WHEN node_name LIKE '%Store' OR node_name LIKE '%Index' THEN 'Repository' ELSE 'Other' END AS role FROM n WHERE node_type = 'class_definition'"""
)
def role_classification(spark, sf_dir):
    """The first suffix that matches decides the architectural role of a class."""
    name = F.col("node_name")
    role = (
        F.when(name.endswith("Service"), "Service")
        .when(name.endswith("Builder") | name.endswith("Planner"), "Factory")
        .when(name.endswith("Router") | name.endswith("Action"), "Controller")
        .when(name.endswith("Model"), "Entity")
        .when(name.endswith("Store") | name.endswith("Index"), "Repository")
        .otherwise("Other")
    )
    return code_nodes(spark, sf_dir, "node_type", "node_name").where("node_type = 'class_definition'").select("id", role.alias("role"))


@catalog.query(f"WITH {NODES_SQL} SELECT id, code FROM n WHERE node_type = 'string' AND regexp_matches(code, '(?i)(password|secret|api_key|token)')")
def literal_secret_scan(spark, sf_dir):
    return code_nodes(spark, sf_dir, "node_type", "code").where("node_type = 'string'").where(F.col("code").rlike("(?i)(password|secret|api_key|token)")).select("id", "code")


@catalog.query(f"WITH {NODES_SQL} SELECT id, substr(source_code, 1, 500) AS preview, length(source_code) AS n_chars FROM n WHERE source_code IS NOT NULL")
def node_source_code(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "source_code").where("source_code is not null")
    return rows.select("id", F.substring("source_code", 1, 500).alias("preview"), F.length("source_code").alias("n_chars"))


# -- joins --------------------------------------------------------------------------
@catalog.query(f"WITH {EDGES_SQL} SELECT s.node_name AS caller, d.node_name AS callee, e.src, e.dst FROM e JOIN n s ON s.id = e.src JOIN n d ON d.id = e.dst WHERE e.edge_type = 'CALLS'")
def typed_one_hop(spark, sf_dir):
    names = code_nodes(spark, sf_dir, "node_name")
    calls = code_edges(spark, sf_dir, "CALLS").select("src", "dst")
    return (
        calls.join(names.select(F.col("id").alias("src"), F.col("node_name").alias("caller")), "src")
        .join(names.select(F.col("id").alias("dst"), F.col("node_name").alias("callee")), "dst")
        .select("caller", "callee", "src", "dst")
    )


@catalog.query(
    f"""WITH {EDGES_SQL}, f AS (SELECT id FROM n WHERE node_type = 'file') SELECT e.src AS id, e.dst AS other, 'outbound' AS direction FROM e JOIN f ON f.id = e.src
WHERE edge_type = 'DEPENDS_ON' UNION ALL SELECT e.dst, e.src, 'inbound' FROM e JOIN f ON f.id = e.dst WHERE edge_type = 'DEPENDS_ON'"""
)
def dependencies(spark, sf_dir):
    files = code_nodes(spark, sf_dir, "node_type").where("node_type = 'file'").select("id")
    links = code_edges(spark, sf_dir, "DEPENDS_ON")
    out = links.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("outbound").alias("direction"))
    back = links.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("inbound").alias("direction"))
    return out.unionByName(back).join(files, "id", "left_semi").select("id", "other", "direction")


def _degrees(spark, sf_dir):
    calls = code_edges(spark, sf_dir, "CALLS")
    fan_out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    fan_in = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return fan_in, fan_out


_DEGREE_SQL = f"""WITH {EDGES_SQL}, c AS (SELECT src, dst FROM e WHERE edge_type = 'CALLS'),
o AS (SELECT src AS id, count(*) AS fan_out FROM c GROUP BY 1), i AS (SELECT dst AS id, count(*) AS fan_in FROM c GROUP BY 1),
d AS (SELECT n.id, n.node_name, n.complexity, n.layer, n.file_path, n.signature, n.project_id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id WHERE n.node_type IN {_FN})"""


def method_degrees(spark, sf_dir):
    """Functions with their numbers of callers and callees; each side is counted before it is joined."""
    fan_in, fan_out = _degrees(spark, sf_dir)
    methods = code_nodes(spark, sf_dir, "node_type", "node_name", "complexity", "layer", "file_path", "signature", "project_id").where(_method())
    return methods.join(fan_in, "id", "left").join(fan_out, "id", "left").fillna(0, ["fan_in", "fan_out"])


@catalog.query(_DEGREE_SQL + " SELECT id, node_name, fan_in, fan_out FROM d")
def fan_in_out(spark, sf_dir):
    return method_degrees(spark, sf_dir).select("id", "node_name", "fan_in", "fan_out")


@catalog.query(_DEGREE_SQL + " SELECT id, node_name, complexity, fan_in, fan_out FROM (SELECT * FROM d WHERE complexity IS NOT NULL ORDER BY complexity DESC, fan_out DESC, id LIMIT 20) t WHERE complexity >= 5")
def code_complexity(spark, sf_dir):
    """The report of the 20 most complex functions; the filter on complexity comes after the limit."""
    rows = method_degrees(spark, sf_dir).where("complexity is not null")
    top = rows.orderBy(F.desc("complexity"), F.desc("fan_out"), "id").limit(20)
    return top.where("complexity >= 5").select("id", "node_name", "complexity", "fan_in", "fan_out")


@catalog.query(
    _DEGREE_SQL
    + """ SELECT id, unnest(list_filter([CASE WHEN complexity >= 10 THEN 'extract_method' END, CASE WHEN fan_out >= 5 THEN 'reduce_coupling' END,
CASE WHEN fan_in >= 10 THEN 'deduplicate' END], lambda x: x IS NOT NULL)) AS advice FROM d"""
)
def suggest_refactoring(spark, sf_dir):
    advice = F.array_compact(
        F.array(
            F.when(F.col("complexity") >= 10, "extract_method"),
            F.when(F.col("fan_out") >= 5, "reduce_coupling"),
            F.when(F.col("fan_in") >= 10, "deduplicate"),
        )
    )
    return method_degrees(spark, sf_dir).select("id", F.explode(advice).alias("advice"))


@catalog.query(_DEGREE_SQL + " SELECT id, node_name FROM d WHERE fan_in = 0 AND node_name NOT IN ('main', 'execute')")
def dead_code(spark, sf_dir):
    called = code_edges(spark, sf_dir, "CALLS").select(F.col("dst").alias("id"))
    methods = code_nodes(spark, sf_dir, "node_type", "node_name").where(_method() & ~F.col("node_name").isin("main", "execute"))
    return methods.join(called, "id", "left_anti").select("id", "node_name")


@catalog.query(
    _DEGREE_SQL
    + """, t AS (SELECT *, split_part(node_name, '_', 1) AS verb FROM d), p AS (SELECT a.id AS id_a, b.id AS id_b,
CASE WHEN a.node_name = b.node_name THEN 0.5 ELSE 0 END + CASE WHEN coalesce(a.layer, '') = coalesce(b.layer, '') THEN 0.1 ELSE 0 END
+ CASE WHEN coalesce(a.signature, '') = coalesce(b.signature, '') THEN 0.2 ELSE 0 END + 0.2 AS score
FROM t a JOIN t b ON a.file_path = b.file_path AND a.id < b.id) SELECT id_a, id_b, round(score, 6) AS score FROM p WHERE score >= 0.5"""
)
def similar_code(spark, sf_dir):
    """Functions of one file by weighted equality of name, layer and signature; nulls are equal."""
    d = method_degrees(spark, sf_dir).select("id", "file_path", "node_name", "layer", "signature")
    a = d.select([F.col(c).alias(f"{c}_a") if c != "file_path" else F.col(c) for c in d.columns])
    b = d.select([F.col(c).alias(f"{c}_b") if c != "file_path" else F.col(c) for c in d.columns])
    same = lambda c: F.coalesce(F.col(f"{c}_a"), F.lit("")) == F.coalesce(F.col(f"{c}_b"), F.lit(""))
    score = (
        F.when(F.col("node_name_a") == F.col("node_name_b"), 0.5).otherwise(0.0)
        + F.when(same("layer"), 0.1).otherwise(0.0)
        + F.when(same("signature"), 0.2).otherwise(0.0)
        + F.lit(0.2)
    )
    # without equal names, only equal layers and signatures together reach the half, so nothing is compared that shares neither
    named = a.join(b, (a.file_path == b.file_path) & (F.col("node_name_a") == F.col("node_name_b")))
    alike = [F.coalesce(F.col(f"{c}_a"), F.lit("")) == F.coalesce(F.col(f"{c}_b"), F.lit("")) for c in ("layer", "signature")]
    shaped = a.join(b, (a.file_path == b.file_path) & alike[0] & alike[1]).where("not node_name_a <=> node_name_b")
    pairs = named.drop(b.file_path).unionByName(shaped.drop(b.file_path)).where("id_a < id_b")
    return pairs.withColumn("score", F.round(score, 6)).where("score >= 0.5").select("id_a", "id_b", "score")


@catalog.query(
    f"""WITH {NODES_SQL}, c AS (SELECT id, node_name, fqn FROM n WHERE node_type = 'class_definition'),
k AS (SELECT id, superclass FROM n WHERE node_type = 'class_definition' AND superclass IS NOT NULL),
x AS (SELECT k.id, c.id AS base, CASE WHEN c.fqn = k.superclass THEN 1 ELSE 2 END AS stage FROM k JOIN c
  ON (c.fqn = k.superclass OR c.node_name = k.superclass) AND c.id <> k.id),
r AS (SELECT *, count(*) OVER (PARTITION BY id, stage) AS n, min(stage) OVER (PARTITION BY id) AS first FROM x)
SELECT id, base, stage FROM r WHERE stage = first AND n = 1"""
)
def resolve_inheritance(spark, sf_dir):
    """Superclass names resolved by full name first, then by a simple name that is unique; never to itself."""
    classes = code_nodes(spark, sf_dir, "node_type", "node_name", "fqn", "superclass").where("node_type = 'class_definition'")
    child = classes.where("superclass is not null").select(F.col("id").alias("child"), "superclass")
    full = child.join(classes.select(F.col("id").alias("base"), F.col("fqn").alias("superclass")), "superclass").withColumn("stage", F.lit(1))
    simple = child.join(classes.select(F.col("id").alias("base"), F.col("node_name").alias("superclass"), "fqn"), "superclass")
    simple = simple.where("not fqn <=> superclass").drop("fqn").withColumn("stage", F.lit(2))
    found = full.unionByName(simple).where("child <> base")
    w = Window.partitionBy("child")
    ranked = found.withColumn("n", F.count("*").over(Window.partitionBy("child", "stage"))).withColumn("first", F.min("stage").over(w))
    return ranked.where("stage = first and n = 1").select(F.col("child").alias("id"), "base", "stage")


@catalog.query(
    f"""WITH {NODES_SQL}, c AS (SELECT DISTINCT callee FROM edges WHERE callee IS NOT NULL), t AS (SELECT id, node_name FROM n WHERE node_type IN {_FN}),
k AS (SELECT c.callee, t.id, count(*) OVER (PARTITION BY c.callee) AS n FROM c JOIN t ON t.node_name = c.callee), p AS (SELECT DISTINCT x.callee, s.file_path FROM edges x JOIN n s ON s.id = x.src WHERE x.callee IS NOT NULL),
f AS (SELECT k.callee, k.id, t.file_path, count(*) OVER (PARTITION BY k.callee, t.file_path) AS here FROM k JOIN n t ON t.id = k.id WHERE k.n > 32)
SELECT callee, id FROM k WHERE n <= 32 UNION ALL SELECT f.callee, f.id FROM f JOIN p ON p.callee = f.callee AND p.file_path = f.file_path WHERE here <= 32"""
)
def resolve_calls_by_name(spark, sf_dir):
    """A callee's name resolves to all definitions of the name if there are at most 32, else to those in a caller's file if they are at most 32."""
    from graphloom.session import table

    edges = table(spark, sf_dir, "edges").select("src", "callee").where("callee is not null")
    callees = edges.select("callee").distinct()
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name", "file_path")
    methods = nodes.where(_method()).select("id", F.col("node_name").alias("callee"), "file_path").join(callees, "callee", "left_semi")
    methods = methods.withColumn("n", F.count("*").over(Window.partitionBy("callee")))
    common = methods.where("n > 32").withColumn("here", F.count("*").over(Window.partitionBy("callee", "file_path")))
    places = edges.join(nodes.select(F.col("id").alias("src"), "file_path"), "src").select("callee", "file_path").distinct()
    near = common.where("here <= 32").join(places, ["callee", "file_path"], "left_semi")
    return methods.where("n <= 32").select("callee", "id").unionByName(near.select("callee", "id"))


@catalog.query(
    f"""WITH {NODES_SQL}, f AS (SELECT id, file_path, line_start, line_end FROM n WHERE node_type IN {_FN} AND line_start IS NOT NULL),
s AS (SELECT id, file_path, line FROM n WHERE node_type = 'call' AND line IS NOT NULL),
x AS (SELECT s.id, f.id AS owner, row_number() OVER (PARTITION BY s.id ORDER BY f.line_end - f.line_start, f.id) AS r FROM s JOIN f
  ON f.file_path = s.file_path AND s.line BETWEEN f.line_start AND f.line_end) SELECT id, owner FROM x WHERE r = 1"""
)
def enclosing_method(spark, sf_dir):
    """The innermost function of the same file whose lines contain a call."""
    nodes = code_nodes(spark, sf_dir, "node_type", "file_path", "line", "line_start", "line_end")
    owners = nodes.where(_method() & F.col("line_start").isNotNull()).select(F.col("id").alias("owner"), "file_path", "line_start", "line_end")
    calls = nodes.where("node_type = 'call' and line is not null").select("id", "file_path", "line")
    hits = calls.join(owners, "file_path").where("line between line_start and line_end")
    return hits.groupBy("id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "owner")).alias("b")).select("id", "b.owner")


@catalog.query(
    f"""WITH {EDGES_SQL}, s AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'TESTS') SELECT n.id, n.node_name, t.id AS test_id FROM n
LEFT JOIN s ON s.dst = n.id LEFT JOIN n t ON t.id = s.src WHERE n.node_type IN {_FN}"""
)
def test_coverage(spark, sf_dir):
    nodes = code_nodes(spark, sf_dir, "node_type", "node_name")
    tests = code_edges(spark, sf_dir, "TESTS").select(F.col("src").alias("test_id"), F.col("dst").alias("id"))
    return nodes.where(_method()).select("id", "node_name").join(tests, "id", "left").select("id", "node_name", "test_id")


@catalog.query(
    """WITH a AS (SELECT DISTINCT file_path FROM source_files WHERE file_path IS NOT NULL), b AS (SELECT DISTINCT file_path FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL)
SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'missing' ELSE 'ghost' END AS state
FROM a FULL JOIN b ON a.file_path = b.file_path WHERE a.file_path IS NULL OR b.file_path IS NULL"""
)
def graph_sync(spark, sf_dir):
    """Files that were scanned but aren't in the graph, and the other way round."""
    from graphloom.session import table

    a = table(spark, sf_dir, "source_files").select("file_path").where("file_path is not null").distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "nodes").where("node_type = 'file' and file_path is not null").select("file_path").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "file_path", "full")
    return both.where("a is null or b is null").select("file_path", F.when(F.col("b").isNull(), "missing").otherwise("ghost").alias("state"))


# -- aggregates -----------------------------------------------------------------------
@catalog.query(f"WITH {NODES_SQL} SELECT project_id, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM n GROUP BY project_id")
def list_projects(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "project_id", "file_path", "language")
    languages = F.array_join(F.array_sort(F.collect_set("language")), ",")
    return rows.groupBy("project_id").agg(
        F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"), F.nullif(languages, F.lit("")).alias("languages")
    )


@catalog.query(
    f"""WITH {NODES_SQL}, x AS (SELECT coalesce(layer, 'none') AS layer, node_type FROM n WHERE node_type IN {_FN} OR node_type = 'class_definition')
SELECT layer, node_type, count(*) AS n FROM x GROUP BY GROUPING SETS ((layer, node_type), (layer), (node_type), ())"""
)
def architecture_metrics(spark, sf_dir):
    rows = code_nodes(spark, sf_dir, "layer", "node_type").where(_method() | (F.col("node_type") == "class_definition"))
    rows = rows.select(F.coalesce("layer", F.lit("none")).alias("layer"), "node_type")
    return rows.cube("layer", "node_type").agg(F.count("*").alias("n"))


@catalog.query(
    f"""WITH {EDGES_SQL} SELECT 'label' AS kind, label AS name, count(*) AS n FROM (SELECT unnest(labels) AS label FROM n) GROUP BY 2
UNION ALL SELECT 'edge', edge_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e"""
)
def graph_stats(spark, sf_dir):
    nodes, edges = code_nodes(spark, sf_dir, "labels"), code_edges(spark, sf_dir)
    by_label = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
    by_type = edges.groupBy(F.col("edge_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    total = nodes.agg(F.count("*").alias("n")).withColumn("name", F.lit("nodes")).unionByName(edges.agg(F.count("*").alias("n")).withColumn("name", F.lit("edges")))
    return by_label.unionByName(by_type).unionByName(total.withColumn("kind", F.lit("total"))).select("kind", "name", "n")


@catalog.query(
    f"""WITH {EDGES_SQL} SELECT s.node_type AS from_type, e.edge_type, string_agg(DISTINCT d.node_type, ',' ORDER BY d.node_type) AS to_types
FROM e JOIN n s ON s.id = e.src JOIN n d ON d.id = e.dst GROUP BY 1, 2"""
)
def graph_schema(spark, sf_dir):
    kinds = code_nodes(spark, sf_dir, "node_type")
    links = (
        code_edges(spark, sf_dir)
        .join(kinds.select(F.col("id").alias("src"), F.col("node_type").alias("from_type")), "src")
        .join(kinds.select(F.col("id").alias("dst"), F.col("node_type").alias("to_type")), "dst")
    )
    return links.groupBy("from_type", "edge_type").agg(F.array_join(F.array_sort(F.collect_set("to_type")), ",").alias("to_types"))


@catalog.query(
    f"""WITH {EDGES_SQL}, s AS (SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e WHERE src = dst) AS self_loops)
SELECT *, round(2.0 * n_edges / n_nodes, 6) AS mean_degree, CASE WHEN n_nodes < 2 THEN 0 ELSE n_edges / (n_nodes * (n_nodes - 1.0)) END AS density FROM s"""
)
def graph_metrics(spark, sf_dir):
    edges = code_edges(spark, sf_dir)
    n = code_nodes(spark, sf_dir, "project_id").agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    size = F.col("n_nodes").cast("double")
    return n.crossJoin(e).select(  # two rows of one line each
        "*",
        F.round(2.0 * F.col("n_edges") / size, 6).alias("mean_degree"),
        F.when(size < 2, 0.0).otherwise(F.col("n_edges") / (size * (size - 1))).alias("density"),
    )


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT src, dst FROM e WHERE edge_type IN ('CALLS', 'DEPENDS_ON')), b AS (SELECT src AS u, dst AS v FROM c UNION SELECT dst, src FROM c),
r AS (SELECT u AS id, u AS low FROM b UNION SELECT b.v, r.low FROM r JOIN b ON b.u = r.id WHERE r.low < b.v)
SELECT component, count(*) AS size FROM (SELECT id, min(low) AS component FROM r GROUP BY id) GROUP BY component"""
)
def component_sizes(spark, sf_dir):
    links = code_edges(spark, sf_dir, "CALLS", "DEPENDS_ON")
    return components(links, "src", "dst").groupBy("component").agg(F.count("*").alias("size"))


@catalog.query(
    f"""WITH {EDGES_SQL}, b AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE edge_type = 'CALLS' AND src <> dst),
s AS (SELECT u AS id, v AS other FROM b UNION ALL SELECT v, u FROM b), d AS (SELECT id, count(*) AS degree FROM s GROUP BY id),
t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM b x JOIN b y ON x.v = y.u JOIN b z ON z.u = x.u AND z.v = y.v),
k AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id)
SELECT d.id, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree < 2 THEN 0 ELSE round(2.0 * coalesce(triangles, 0) / (degree * (degree - 1)), 6) END AS clustering
FROM d LEFT JOIN k ON k.id = d.id"""
)
def clustering_coefficient(spark, sf_dir):
    rows = traversal.triangles(code_edges(spark, sf_dir, "CALLS"))
    d = F.col("degree")
    return rows.withColumn("clustering", F.when(d < 2, 0.0).otherwise(F.round(2.0 * F.col("triangles") / (d * (d - 1)), 6)))


@catalog.query(
    f"""WITH {EDGES_SQL}, b AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) SELECT id FROM b GROUP BY id HAVING count(*) = 1"""
)
def degree_one_nodes(spark, sf_dir):
    edges = code_edges(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    return ends.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")


@catalog.query(
    """SELECT project_id, count(*) AS calls, count(callsite_id) AS with_site, count(DISTINCT callsite_id) AS sites,
count(*) FILTER (WHERE is_virtual) AS virtual_calls, round(count(resolution) * 1.0 / count(*), 4) AS resolved_share
FROM edges WHERE upper(trim(edge_type)) = 'CALLS' GROUP BY project_id"""
)
def call_resolution_metrics(spark, sf_dir):
    from graphloom.session import table

    calls = table(spark, sf_dir, "edges").where(F.upper(F.trim("edge_type")) == "CALLS")
    return calls.groupBy("project_id").agg(
        F.count("*").alias("calls"),
        F.count("callsite_id").alias("with_site"),
        F.countDistinct("callsite_id").alias("sites"),
        F.count_if(F.coalesce("is_virtual", F.lit(False))).alias("virtual_calls"),
        F.round(F.count("resolution") / F.count("*"), 4).alias("resolved_share"),
    )


# -- traversal -----------------------------------------------------------------------
_SEED_SQL = f"(SELECT id FROM n WHERE node_type IN {_FN} AND is_source)"


def _sources(spark, sf_dir):
    return code_nodes(spark, sf_dir, "node_type", "is_source").where(_method() & F.coalesce("is_source", F.lit(False))).select("id")


def _reach_sql(edge: str, seeds: str, depth: int, swap: bool = False) -> str:
    a, b = ("dst", "src") if swap else ("src", "dst")
    return f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT {a} AS u, {b} AS v FROM e WHERE edge_type IN ({edge})),
r AS (SELECT id AS seed, id, 0 AS depth FROM {seeds} UNION SELECT r.seed, w.v, r.depth + 1 FROM r JOIN w ON w.u = r.id WHERE r.depth < {depth})
SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id"""


@catalog.query(_reach_sql("'CALLS'", _SEED_SQL, 3))
def call_graph(spark, sf_dir):
    return traversal.reach(code_edges(spark, sf_dir, "CALLS"), _sources(spark, sf_dir), 3).select("seed", "id", "depth")


@catalog.query(_reach_sql("'CALLS', 'DEPENDS_ON'", f"(SELECT id FROM n WHERE node_type IN {_FN} AND is_sink)", 5, swap=True))
def change_impact(spark, sf_dir):
    """What reaches a sink within five steps, by the least distance."""
    seeds = code_nodes(spark, sf_dir, "node_type", "is_sink").where(_method() & F.coalesce("is_sink", F.lit(False))).select("id")
    return traversal.reach(code_edges(spark, sf_dir, "CALLS", "DEPENDS_ON"), seeds, 5, "in").select("seed", "id", "depth")


@catalog.query(_reach_sql("'REACHES', 'FLOWS_TO'", "(SELECT DISTINCT src AS id FROM e WHERE edge_type = 'REACHES')", 4))
def variable_trace(spark, sf_dir):
    edges = code_edges(spark, sf_dir, "REACHES", "FLOWS_TO")
    seeds = code_edges(spark, sf_dir, "REACHES").select(F.col("src").alias("id"))
    return traversal.reach(edges, seeds, 4).select("seed", "id", "depth")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT src AS u, dst AS v FROM e WHERE edge_type IN ('REACHES', 'FLOWS_TO', 'CALLS')),
p AS (SELECT src AS parent, dst AS child FROM e WHERE edge_type = 'PARENT_OF'),
t AS (SELECT id AS source, id, 0 AS depth FROM n WHERE is_source UNION SELECT t.source, w.v, t.depth + 1 FROM t JOIN w ON w.u = t.id WHERE t.depth < 10),
k AS (SELECT id AS sink, id, 0 AS d FROM n WHERE is_sink UNION SELECT k.sink, p.child, k.d + 1 FROM k JOIN p ON p.parent = k.id WHERE k.d < 6)
SELECT DISTINCT t.source, k.sink FROM t JOIN k ON k.id = t.id"""
)
def taint_paths(spark, sf_dir):
    """Sources whose data reach a sink or a part of it."""
    flags = code_nodes(spark, sf_dir, "is_source", "is_sink")
    flow = traversal.reach(code_edges(spark, sf_dir, "REACHES", "FLOWS_TO", "CALLS"), flags.where("is_source").select("id"), 10)
    parts = traversal.reach(code_edges(spark, sf_dir, "PARENT_OF"), flags.where("is_sink").select("id"), 6)
    return (
        flow.select(F.col("seed").alias("source"), "id")
        .join(parts.select(F.col("seed").alias("sink"), "id"), "id")
        .select("source", "sink")
        .distinct()
    )


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src AS u, dst AS v FROM e WHERE edge_type IN ('CALLS', 'CONTAINS') UNION SELECT dst, src FROM e WHERE edge_type IN ('CALLS', 'CONTAINS')),
r AS (SELECT id, 0 AS depth FROM n WHERE is_source UNION SELECT b.v, r.depth + 1 FROM r JOIN b ON b.u = r.id WHERE r.depth < 2),
k AS (SELECT DISTINCT id FROM r) SELECT e.src, e.dst, e.edge_type FROM e WHERE edge_type IN ('CALLS', 'CONTAINS') AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"""
)
def subgraph_around(spark, sf_dir):
    """All edges among the nodes within two hops of a source."""
    seeds = code_nodes(spark, sf_dir, "is_source").where("is_source").select("id")
    _, inner = traversal.neighbourhood(code_edges(spark, sf_dir, "CALLS", "CONTAINS"), seeds, 2)
    return inner.select("src", "dst", "edge_type")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, i AS (SELECT src, dst FROM e WHERE edge_type = 'IMPLEMENTS'), r AS (SELECT src, dst FROM i UNION SELECT r.src, i.dst FROM r JOIN i ON i.src = r.dst)
SELECT src, dst FROM r"""
)
def transitive_inheritance(spark, sf_dir):
    return traversal.transitive_closure(code_edges(spark, sf_dir, "IMPLEMENTS"))


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, p AS (SELECT dst AS child, src AS parent FROM e WHERE edge_type = 'PARENT_OF'),
u AS (SELECT id, id AS at, 0 AS d FROM n WHERE node_type = 'call' UNION SELECT u.id, p.parent, u.d + 1 FROM u JOIN p ON p.child = u.at WHERE u.d < 15),
x AS (SELECT u.id, u.at AS owner, u.d, row_number() OVER (PARTITION BY u.id ORDER BY u.d, u.at) AS r FROM u JOIN n ON n.id = u.at WHERE n.node_type IN {_FN})
SELECT id, owner, d AS distance FROM x WHERE r = 1"""
)
def callsite_owner(spark, sf_dir):
    """The nearest function above a call, within 15 steps up the tree."""
    nodes = code_nodes(spark, sf_dir, "node_type")
    up = traversal.ancestors(code_edges(spark, sf_dir, "PARENT_OF"), nodes.where("node_type = 'call'").select("id"), 15)
    methods = nodes.where(_method()).select(F.col("id").alias("ancestor"))
    near = up.join(methods, "ancestor", "left_semi").groupBy("id").agg(F.min(F.struct("distance", F.col("ancestor").alias("owner"))).alias("b"))
    return near.select("id", "b.owner", "b.distance")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT src AS u, dst AS v FROM e WHERE edge_type = 'CALLS'),
r AS (SELECT id AS seed, id, 0 AS depth FROM {_SEED_SQL} UNION SELECT r.seed, w.v, r.depth + 1 FROM r JOIN w ON w.u = r.id WHERE r.depth < 3),
d AS (SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id)
SELECT d.seed, d.id, d.depth, min(p.id) AS parent FROM d LEFT JOIN w ON w.v = d.id LEFT JOIN d p ON p.seed = d.seed AND p.id = w.u AND p.depth = d.depth - 1 GROUP BY 1, 2, 3"""
)
def spanning_tree(spark, sf_dir):
    """Breadth-first tree of the call graph from each source, with the parent of each node."""
    return traversal.reach(code_edges(spark, sf_dir, "CALLS"), _sources(spark, sf_dir), 3)


COMMUNITY_SQL = (
    f"{EDGES_SQL}, g AS (SELECT src, dst FROM e WHERE edge_type IN ('CALLS', 'DEPENDS_ON') AND src <> dst), b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), l0 AS (SELECT DISTINCT src AS id, src AS community FROM b)"
    + "".join(
        f", v{k} AS (SELECT b.src, community, count(*) AS n FROM b JOIN l{k} ON l{k}.id = b.dst GROUP BY 1, 2), l{k + 1} AS (SELECT src AS id, community FROM v{k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, community) = 1)"
        for k in range(5)
    )
)


@catalog.query(
    f"""WITH {COMMUNITY_SQL}, w AS (SELECT DISTINCT community, unnest(string_split(regexp_replace(lower(regexp_replace(n.node_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')) AS word FROM l5 JOIN n USING (id) WHERE n.node_name IS NOT NULL),
q(word) AS (VALUES ('load'), ('index'), ('layer'), ('merge'), ('queue')), t AS (SELECT community, count(*) AS hits, row_number() OVER (ORDER BY count(*) DESC, community) AS rank FROM w JOIN q USING (word) GROUP BY 1),
m AS (SELECT t.community, t.rank, n.id, n.node_name, row_number() OVER (PARTITION BY t.community ORDER BY n.id) AS place FROM t JOIN l5 USING (community) JOIN n USING (id) WHERE t.rank <= 3)
SELECT community, rank, id, node_name FROM m WHERE place <= 10"""
)
def community_retrieval(spark, sf_dir):
    """The three communities whose names share most words with a question, with up to ten members each."""
    nodes = code_nodes(spark, sf_dir, "node_name")
    groups = cut_lineage(traversal.label_propagation(code_edges(spark, sf_dir, "CALLS", "DEPENDS_ON")))
    named = groups.join(nodes, "id")
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace("node_name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "), " ")
    held = named.where("node_name is not null").select("community", F.explode(words).alias("word")).distinct()
    asked = spark.createDataFrame([(w,) for w in ("load", "index", "layer", "merge", "queue")], "word string")
    hits = held.join(asked, "word").groupBy("community").agg(F.count("*").alias("hits"))
    best = hits.orderBy(F.desc("hits"), "community").limit(3)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "community")))  # three rows
    members = named.join(ranked, "community").withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy("id")))
    return members.where("place <= 10").select("community", "rank", "id", "node_name")


@catalog.query(f"WITH {COMMUNITY_SQL} SELECT id, community FROM l5")
def communities(spark, sf_dir):
    """Deterministic label propagation over calls and dependencies."""
    return traversal.label_propagation(code_edges(spark, sf_dir, "CALLS", "DEPENDS_ON"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
