"""Queries that derive a code graph from sources, and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import codegraph, javagraph
from graphloom.plans.catalog import Catalog
from graphloom.session import cut_lineage, table
from graphloom.streaming import incremental

catalog = Catalog()


def _python(spark, sf_dir):
    return codegraph.python_graph(table(spark, sf_dir, "source_files").where(F.col("file_path").endswith(".py")))


@catalog.query()
def pyast_nodes(spark, sf_dir):
    return _python(spark, sf_dir)[0]


@catalog.query()
def pycfg_edges(spark, sf_dir):
    return _python(spark, sf_dir)[1].where("edge_type = 'FLOWS_TO'")


@catalog.query()
def reaching_definitions(spark, sf_dir):
    return _python(spark, sf_dir)[1].where("edge_type = 'REACHES'")


@catalog.query()
def py_call_graph(spark, sf_dir):
    return codegraph.resolve_calls(*_python(spark, sf_dir))


_DECLARED = """SELECT DISTINCT file_path, node_name FROM nodes WHERE node_type = '{0}' AND node_name IS NOT NULL AND file_path LIKE '%{1}' AND file_path IN (SELECT file_path FROM source_files WHERE code IS NOT NULL)"""


def _declared(spark, sf_dir, parsed, kind):
    """The functions of the node table that parsing its file finds, too."""
    known = table(spark, sf_dir, "nodes").where(F.col("node_type") == kind).select("file_path", "node_name").dropna()
    found = parsed.where(F.col("node_type") == kind).select("file_path", "node_name")
    return known.join(found, ["file_path", "node_name"], "left_semi").distinct()


@catalog.query(_DECLARED.format("function_definition", ".py"))
def py_declarations(spark, sf_dir):
    return _declared(spark, sf_dir, _python(spark, sf_dir)[0], "function_definition")


def _java(spark, sf_dir):
    return javagraph.java_graph(table(spark, sf_dir, "source_files").where(F.col("file_path").endswith(".java")))


@catalog.query()
def java_nodes(spark, sf_dir):
    return _java(spark, sf_dir)[0]


@catalog.query(_DECLARED.format("method_declaration", ".java"))
def java_declarations(spark, sf_dir):
    return _declared(spark, sf_dir, _java(spark, sf_dir)[0], "method_declaration")


@catalog.query()
def java_flow(spark, sf_dir):
    """Control flow and reaching definitions of Java methods."""
    return _java(spark, sf_dir)[1].where("edge_type in ('FLOWS_TO', 'REACHES')")


@catalog.query()
def java_calls(spark, sf_dir):
    nodes, edges = (cut_lineage(x) for x in _java(spark, sf_dir))
    return javagraph.resolve_calls(nodes, edges)


@catalog.query()
def expanded_functions(spark, sf_dir):
    """The inner flow of all functions with sources, each parsed on its own."""
    from graphloom.plugins import expand

    rows = table(spark, sf_dir, "nodes").where("source_code is not null and file_path is not null")
    return expand(rows.select("id", "file_path", "source_code").distinct()).where("edge_type in ('FLOWS_TO', 'REACHES')")


@catalog.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf_dir):
    return incremental.windowed_counts(incremental.read_table(spark, sf_dir, "events"), "ts", "1 hour", "7 days", ["event_type"], "counts")


@catalog.query(
    "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"
)
def stream_upsert(spark, sf_dir):
    rows = incremental.read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return incremental.upsert_stream(rows, "user_id", ["ts", "event_id"], "upsert").select("user_id", "event_id", "event_type")


@catalog.query(
    "SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"
)
def stream_last_three(spark, sf_dir):
    return incremental.last_n(incremental.read_table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 3, "last")


QUERIES, ORACLE = catalog.queries, catalog.oracle
