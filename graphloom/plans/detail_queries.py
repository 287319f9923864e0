"""Queries of single records and their surroundings: details, filters by attributes, previews, paths, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators import traversal
from graphloom.plans.catalog import EDGES_SQL, MEMORY_SQL, NODES_SQL, Catalog
from graphloom.plans.graph_queries import COMMUNITY_SQL
from graphloom.plans.hits import HITS_SQL, hits
from graphloom.sources import files
from graphloom.sources.graph_tables import code_edges, code_nodes, memory_edges, memory_nodes
from graphloom.session import table

catalog = Catalog()


def matches(alternatives: list[dict[str, object]], every: bool = False) -> Column:
    """Whether a row has all attributes of one of the alternatives, or with ``every`` of all; a list of values means any of them."""
    def one(attributes: dict[str, object]) -> Column:
        tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k).eqNullSafe(F.lit(v)) for k, v in attributes.items()]
        return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))

    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), map(one, alternatives))


@catalog.query(
    f"""WITH {NODES_SQL} SELECT id, node_type, layer FROM n WHERE (node_type = 'method_declaration' AND layer IN ('web', 'data')) OR (node_type = 'function_definition' AND is_source)"""
)
def attribute_filter(spark, sf_dir):
    """Nodes by alternatives of attributes that must hold together."""
    nodes = code_nodes(spark, sf_dir, "node_type", "layer", "is_source")
    found = nodes.where(matches([{"node_type": "method_declaration", "layer": ["web", "data"]}, {"node_type": "function_definition", "is_source": True}]))
    return found.select("id", "node_type", "layer")


@catalog.query(
    f"""WITH {EDGES_SQL}, o AS (SELECT src AS id, count(*) AS n_out, count(DISTINCT edge_type) AS kinds FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in FROM e GROUP BY 1)
SELECT n.id, node_type, array_to_string(labels, ':') AS labels, node_name, fqn, file_path, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(kinds, 0) AS kinds FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)"""
)
def node_detail(spark, sf_dir):
    """Every node with its labels and the number of its edges and of their types."""
    edges = code_edges(spark, sf_dir)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.count_distinct("edge_type").alias("kinds"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    nodes = code_nodes(spark, sf_dir, "node_type", "labels", "node_name", "fqn", "file_path").withColumn("labels", F.array_join("labels", ":"))
    return nodes.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_in", "n_out", "kinds"])


@catalog.query(
    f"""WITH {MEMORY_SQL}, g AS (SELECT id, node_type FROM m WHERE status = 'deprecated') SELECT node_type AS what, count(*) AS n FROM g GROUP BY 1
UNION ALL SELECT 'edge ' || relationship_name, count(*) FROM (SELECT DISTINCT src, dst, relationship_name FROM me WHERE relationship_name IS NOT NULL AND (src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g))) GROUP BY 1"""
)
def delete_preview(spark, sf_dir):
    """What deleting all deprecated nodes would take along, by type."""
    gone = memory_nodes(spark, sf_dir).where("status = 'deprecated'").select("id", "node_type")
    edges = memory_edges(spark, sf_dir).select("src", "dst", "relationship_name").where("relationship_name is not null").distinct()
    touched = edges.join(gone.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
    nodes = gone.groupBy(F.col("node_type").alias("what")).agg(F.count("*").alias("n"))
    return nodes.unionByName(touched.groupBy(F.concat(F.lit("edge "), "relationship_name").alias("what")).agg(F.count("*").alias("n")))


@catalog.query(
    f"""WITH {COMMUNITY_SQL} SELECT community, count(*) AS size, (SELECT count(DISTINCT community) FROM l5) AS communities, min(id) AS first, max(id) AS last FROM l5 GROUP BY community"""
)
def community_sizes(spark, sf_dir):
    """The communities with their size and ends in the order of ids, and how many there are."""
    groups = traversal.label_propagation(code_edges(spark, sf_dir, "CALLS", "DEPENDS_ON"))
    sized = groups.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last"))
    return sized.crossJoin(sized.agg(F.count("*").alias("communities")))  # one row of totals


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'CALLS' AND src <> dst), s AS (SELECT id FROM n WHERE is_source),
p AS (SELECT id AS start, [id] AS path FROM s UNION ALL SELECT p.start, list_append(p.path, c.dst) FROM p JOIN c ON c.src = p.path[-1] WHERE len(p.path) <= 3 AND NOT list_contains(p.path, c.dst))
SELECT start, array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM p WHERE len(path) > 1"""
)
def expanded_paths(spark, sf_dir):
    """All ways of one to three calls from each source that pass no function twice."""
    return expand_paths(code_edges(spark, sf_dir, "CALLS"), code_nodes(spark, sf_dir, "is_source").where("is_source").select("id"), 3).withColumn("path", F.array_join("path", ">"))


def expand_paths(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(start, path, hops) of every way of at most ``most`` steps from the seeds that passes no node twice."""
    steps = edges.select("src", "dst").where("src <> dst").distinct()
    front = seeds.select(F.col("id").alias("start"), F.array("id").alias("path"))
    out = None
    for k in range(1, most + 1):
        front = front.withColumn("src", F.element_at("path", -1)).join(steps, "src").where(~F.array_contains("path", F.col("dst")))
        front = front.select("start", F.concat("path", F.array("dst")).alias("path"))
        here = front.withColumn("hops", F.lit(k))
        out = here if out is None else out.unionByName(here)
    return out


def _slice_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, g AS (SELECT DISTINCT {a} AS u, {b} AS v FROM e WHERE edge_type IN ('REACHES', 'FLOWS_TO')), s AS (SELECT DISTINCT id FROM n JOIN g ON g.u = n.id WHERE node_type = 'assignment'),
r AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT r.seed, g.v, r.depth + 1 FROM r JOIN g ON g.u = r.id WHERE r.depth < 3) SELECT seed, count(DISTINCT id) AS size FROM r GROUP BY seed"""


def _slice(spark, sf_dir, direction):
    edges = code_edges(spark, sf_dir, "REACHES", "FLOWS_TO").select("src", "dst").distinct()
    end = "dst" if direction == "in" else "src"
    seeds = code_nodes(spark, sf_dir, "node_type").where("node_type = 'assignment'").select("id").join(edges.select(F.col(end).alias("id")), "id", "left_semi")
    return traversal.reach(edges, seeds, 3, direction).groupBy("seed").agg(F.count("*").alias("size"))


@catalog.query(_slice_sql("dst", "src"))
def backward_slices(spark, sf_dir):
    """How many nodes each assignment depends on within three steps, itself included."""
    return _slice(spark, sf_dir, "in")


@catalog.query(_slice_sql("src", "dst"))
def forward_slices(spark, sf_dir):
    return _slice(spark, sf_dir, "out")


@catalog.query(
    f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT DISTINCT dst AS u, src AS v FROM e WHERE edge_type = 'CALLS'), s AS (SELECT id FROM n WHERE starts_with(node_name, 'load')),
r AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT r.seed, c.v, r.depth + 1 FROM r JOIN c ON c.u = r.id WHERE r.depth < 2) SELECT seed AS function, id AS caller, min(depth) AS depth FROM r WHERE id <> seed GROUP BY 1, 2"""
)
def callers_of(spark, sf_dir):
    """The callers of some functions, and theirs."""
    seeds = code_nodes(spark, sf_dir, "node_name").where("startswith(node_name, 'load')").select("id")
    found = traversal.reach(code_edges(spark, sf_dir, "CALLS"), seeds, 2, "in").where("depth > 0")
    return found.select(F.col("seed").alias("function"), F.col("id").alias("caller"), "depth")


@catalog.query(
    f"""WITH {MEMORY_SQL}, t AS (SELECT DISTINCT src, dst, relationship_name FROM me WHERE relationship_name IS NOT NULL), k AS (SELECT src AS id, relationship_name, 'out' AS way, dst AS other FROM t UNION ALL SELECT dst, relationship_name, 'in', src FROM t)
SELECT k.id, way, relationship_name, other FROM k JOIN m ON m.id = k.id WHERE m.node_type = 'Facet' AND other IS NOT NULL"""
)
def triplets_of_nodes(spark, sf_dir):
    """The edges at each facet, in both directions."""
    t = memory_edges(spark, sf_dir).select("src", "dst", "relationship_name").where("relationship_name is not null").distinct()
    ends = [t.select(F.col(a).alias("id"), F.lit(way).alias("way"), "relationship_name", F.col(b).alias("other")) for a, b, way in (("src", "dst", "out"), ("dst", "src", "in"))]
    facets = memory_nodes(spark, sf_dir).where("node_type = 'Facet'").select("id")
    return ends[0].unionByName(ends[1]).where("other is not null").join(facets, "id", "left_semi")


@catalog.query(
    f"""WITH {MEMORY_SQL}, {HITS_SQL}, x AS (SELECT DISTINCT coalesce(nullif(trim(edge_text), ''), relationship_name) AS label, dst FROM me) SELECT label, round(min(h.d), 6) AS best, count(DISTINCT h.id) AS n FROM x JOIN h ON h.id = x.dst WHERE label IS NOT NULL GROUP BY label"""
)
def edge_hit_map(spark, sf_dir):
    """The best distance of each edge text among the hits that its edges lead to."""
    label = F.coalesce(F.nullif(F.trim("edge_text"), F.lit("")), F.col("relationship_name"))
    rows = memory_edges(spark, sf_dir).select(label.alias("label"), F.col("dst").alias("id")).where("label is not null").distinct()
    return rows.join(hits(spark, sf_dir).select("id", "d"), "id").groupBy("label").agg(F.round(F.min("d"), 6).alias("best"), F.count_distinct("id").alias("n"))


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@catalog.query(
    f"""WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(max(greatest(0, {_COS})), 6) AS similarity FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1"""
)
def max_similarities(spark, sf_dir):
    """The largest similarity, at least 0, of every hundredth vector with another of its label: a stated set against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    pairs = asked.join(rows, "label").where("a <> vec_id")
    return pairs.groupBy(F.col("a").alias("vec_id")).agg(F.round(F.max(F.greatest(F.lit(0.0), V.cosine(F.col("va"), F.col("embedding")))), 6).alias("similarity"))


@catalog.query(
    r"""WITH v AS (SELECT DISTINCT file_path AS given FROM source_files WHERE file_path IS NOT NULL UNION SELECT DISTINCT title FROM documents WHERE title IS NOT NULL UNION SELECT DISTINCT unnest(regexp_extract_all(code, '(https?://[A-Za-z0-9./_-]+)', 1)) FROM source_files)
SELECT given, CASE WHEN regexp_matches(given, '(?i)^\s*https?://\S+\s*$') THEN 'url' WHEN regexp_matches(given, '(?i)^\s*s3a?://\S+\s*$') THEN 's3' WHEN regexp_matches(given, '^\s*(?:file://)?(?:[~.]{0,2}/)?[\w.-]+(?:/[\w.-]+)*\.\w{1,8}\s*$') THEN 'file' ELSE 'text' END AS kind FROM v WHERE given IS NOT NULL"""
)
def input_kinds(spark, sf_dir):
    """What callers hand over: paths, titles and addresses."""
    code, docs = table(spark, sf_dir, "source_files"), table(spark, sf_dir, "documents")
    urls = code.select(F.explode(F.regexp_extract_all("code", F.lit("(https?://[A-Za-z0-9./_-]+)"), 1)).alias("given"))
    given = code.select(F.col("file_path").alias("given")).union(docs.select("title")).union(urls).where("given is not null").distinct()
    return given.select("given", files.classify_input(F.col("given")).alias("kind"))


@catalog.query(
    f"""WITH {EDGES_SQL}, f AS (SELECT DISTINCT src, dst FROM e WHERE edge_type = 'FLOWS_TO'), k AS (SELECT n.id, file_path, line FROM n WHERE line IS NOT NULL AND id IN (SELECT src FROM f UNION SELECT dst FROM f))
SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM k WINDOW w AS (PARTITION BY file_path ORDER BY line, id)"""
)
def flow_neighbours(spark, sf_dir):
    """The nodes of control flow with those before and behind them in their file."""
    flow = code_edges(spark, sf_dir, "FLOWS_TO")
    ends = flow.select(F.col("src").alias("id")).union(flow.select("dst")).distinct()
    rows = code_nodes(spark, sf_dir, "file_path", "line").where("line is not null").join(ends, "id", "left_semi")
    w = Window.partitionBy("file_path").orderBy("line", "id")
    return rows.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
