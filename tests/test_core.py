import ast
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.functions import ids, rules, text, vectors
from graphloom.operators import chunking, codegraph, evaluation, memory, retrieval, traversal
from graphloom.sources import files, relational


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_uuid5(spark):
    for name in ("hello world", "Schön", "概念"):
        assert one(spark, ids.uuid5(F.col("s")), s=name) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))
    assert one(spark, ids.memory_id(F.col("s")), s="It's Me") == str(uuid.uuid5(uuid.NAMESPACE_OID, "its_me"))


def test_bm25_of_one_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "the of")], "doc_id long, text string")
    got = retrieval.bm25(docs, spark.createDataFrame([(7, "alpha")], "query_id long, text string")).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(7, 1)]
    assert got[0].score == pytest.approx(0.2876820724517809 * 2.5 / (1 + 1.5))


def test_rrf(spark):
    dense = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    sparse = spark.createDataFrame([("q", "b", 1)], "query_id string, id string, rank int")
    assert {r.id: r.distance for r in retrieval.rrf(dense, sparse, ["query_id", "id"]).collect()} == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize(
    ("hits", "score", "path"),
    [
        ([("e", 0.2)], 0.5, "direct_episode"),
        ([("p", 0.1)], 2.0, "point"),
        ([("f", 0.05)], 0.2, "facet"),
        ([("n", 0.1)], 1.05, "entity"),
    ],
)
def test_bundles(spark, hits, score, path):
    edges = spark.createDataFrame(
        [("e", "f", "has_facet", None), ("f", "p", "has_point", None), ("e", "n", "involves_entity", None)],
        "src string, dst string, relationship_name string, edge_text string",
    )
    got = retrieval.episode_bundles(edges, spark.createDataFrame(hits, "id string, score double")).collect()
    assert [(r.episode, r.score, r.path) for r in got] == [("e", score, path)]


def test_time_overlap_and_bonus(spark):
    lit = [F.lit(x) for x in (0, 10, 5, 25)]
    assert one(spark, retrieval.time_overlap(*lit)) == 0.5
    assert one(spark, retrieval.time_overlap(*[F.lit(x) for x in (0, 10, 10, 20)])) == 0.0
    bonus = retrieval.time_bonus(F.lit(0), F.lit(10), F.lit(0.7), F.lit(None).cast("long"), F.lit(0), F.lit(10), 0.9)
    assert one(spark, bonus) == pytest.approx(0.0378)
    assert [round(one(spark, retrieval.gap_factor(F.lit(g))), 6) for g in (0.05, 0.10, 0.20)] == [0.6, 0.8, 1.0]


def test_traversal(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert rows(traversal.reach(edges, seed, 5), "id", "depth", "parent") == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")]
    assert rows(traversal.shortest_path(edges, "b", "a", 3, "out")) == [(0, "b"), (1, "d"), (2, "a")]
    assert traversal.transitive_closure(edges).count() == 16
    assert rows(traversal.triangles(edges.unionByName(spark.createDataFrame([("b", "c")], "src string, dst string"))), "id", "triangles")[0] == ("a", 3)
    assert len({r.community for r in traversal.label_propagation(edges).collect()}) <= 4


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.70710678)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_text_rules(spark):
    assert one(spark, rules.redact(F.col("s")), s="password: abc and bearer " + "x" * 20) == "[REDACTED_PASSWORD] and [REDACTED_BEARER_TOKEN]"
    assert one(spark, text.nfkc(F.col("s")), s="ﬁｎ①") == "fin1" and one(spark, text.narrow(F.col("s")), s="Ａ１　") == "A1 "
    assert one(spark, text.search_text_quality(F.col("s")), s="42") == "CRITICAL:digits"
    assert one(spark, text.truncate(F.col("s"), 4), s="abcdef") == "abc…"
    assert one(spark, text.tokens(F.col("s")), s="Schön ist's") == ["schön", "ist", "s"]


def test_memory(spark, rows):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("b", None, 5), ("c", "z", 3)], "id string, name string, n int")
    assert rows(memory.upsert_nodes(old, new)) == [("a", "x", 1), ("b", "y", 5), ("c", "z", 3)]
    times = spark.createDataFrame([("k", 0, 10, 0.5), ("k", 10, 40, 0.9), ("k", 9, 1, 0.1), ("k", None, 1, 0.1)], "g string, start_ms long, end_ms long, confidence double")
    assert rows(memory.merge_times(times, "g")) == [("k", 0, 40, pytest.approx(0.8))]
    vecs = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.99, 0.01]), ("g", 3, [0.0, 1.0])], "g string, id long, vec array<double>")
    assert rows(memory.greedy_clusters(vecs, "g")) == [("g", 1, 1), ("g", 2, 1), ("g", 3, 3)]
    steps = rules.conflict(F.array(F.lit("a")), F.array(F.lit("b")), F.lit("Remove it"), F.lit(""), F.lit(""))
    assert one(spark, steps) == pytest.approx(0.7)


def test_chunks():
    body = "One two three. Four five six seven. Eight nine ten."
    assert [c[0] for c in chunking.pack_chunks(body, 7)] == ["One two three. Four five six seven.", "Eight nine ten."]
    assert [c[0] for c in chunking.pack_chunks(body, 7, 0.6)] == ["One two three. Four five six seven.", "Four five six seven. Eight nine ten."]
    assert sum(c[1] for c in chunking.pack_chunks("a " * 50, 8)) == 50
    assert [r[2] for r in chunking.split_rows("a: 1, b: 2\n\nc: 3", 2)] == ["row_cut", "row_end", "row_end"]


SOURCE = """
import os

def f(x, n):
    y = x
    while n:
        if y:
            y = y + 1
            break
        n -= 1
    return y

class K:
    def g(self):
        return f(1, 2)
"""


def test_code_graph():
    fn = ast.parse(SOURCE).body[1]
    assert codegraph.complexity(fn) == 3
    flow = {(type(a).__name__ if not isinstance(a, str) else a, type(b).__name__ if not isinstance(b, str) else b) for a, b, _ in codegraph.control_flow(fn)}
    assert ("entry", "Assign") in flow and ("Break", "Return") in flow and ("AugAssign", "While") in flow and ("Return", "exit") in flow
    uses = {(d if isinstance(d, str) else d.lineno, u.lineno, v) for d, u, v in codegraph.reaching_definitions(fn)}
    assert ("entry", 5, "x") in uses and (5, 11, "y") in uses and (8, 11, "y") in uses and (10, 6, "n") in uses
    nodes, edges = codegraph.derive("p.py", SOURCE)
    assert {n[2] for n in nodes if n[1] == "function_definition"} == {"f", "g"}
    assert any(e[1:] == ("f", "CALLS", "name") for e in edges)
    assert codegraph.derive("p.py", "def (") == ([], [])


def test_sources(spark, rows, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("grün".encode("latin-1"))
    (tmp_path / "a" / "y.md").write_text("grün", encoding="utf-8")
    found = files.scan(spark, str(tmp_path), ["txt", "md"]).select(files.decode(F.col("content")).alias("t"))
    assert rows(found) == [("grün",), ("grün",)]
    assert one(spark, files.dataset_of(F.col("p")), p="a/b/c.py") == "a.b"
    assert one(spark, files.path_after("http://h.org/base/", F.col("u")), u="http://h.org/base/x/y") == "/x/y"
    t = relational.Table("t", "k", (("r", "u"),))
    df = spark.createDataFrame([(1, 2, "v"), (2, None, None)], "k int, r int, v string")
    assert rows(relational.foreign_edges(df, t)) == [("t:1", "u:2", "r")]
    assert rows(relational.value_edges(df, t)) == [("t:1", "t:v:v", "v")]


def test_openapi(spark, rows):
    spec = '{"openapi": "3.0.0", "paths": {"/a": {"get": {"operationId": "readA"}, "parameters": []}, "/b/{id}": {"post": {}, "delete": {"operationId": "dropB"}}}}'
    df = spark.createDataFrame([("s.json", spec), ("x.json", "{}"), ("y.json", None), ("z.json", "no json")], "path string, text string")
    assert rows(files.openapi_endpoints(df), "endpoint", "method", "operation_id") == [("/a", "GET", "readA"), ("/b/{id}", "DELETE", "dropB"), ("/b/{id}", "POST", None)]


def test_evaluation(spark, rows):
    expected = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "query_id int, type string, id string")
    results = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "query_id int, id string, rank int")
    assert rows(evaluation.recall_at(results, expected), "type", "recall_at_1", "recall_at_3") == [("x", 1.0, 1.0), ("y", 0.0, 1.0), (None, 0.5, 1.0)]
    m = "metric string, value double"
    got = evaluation.regressions(spark.createDataFrame([("recall", 0.5), ("false_rate", 0.1)], m), spark.createDataFrame([("recall", 0.6), ("false_rate", 0.1)], m))
    assert rows(got, "metric", "regressed") == [("false_rate", False), ("recall", True)]


def test_api(spark, rows):
    store = api.GraphStore(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("a", "b", "T")], "src string, dst string, edge_type string"))
    grown = store.upsert(spark.createDataFrame([("c", 3)], "id string, v int"), spark.createDataFrame([("b", "c", "T"), ("b", "q", "T")], "src string, dst string, edge_type string"))
    assert grown.edges.count() == 2
    assert [r.id for r in grown.get(["c", "zz", "a"]).collect()] == ["c", "a"]
    assert rows(grown.path("a", "c")) == [(0, "a"), (1, "b"), (2, "c")]
    assert grown.delete(spark.createDataFrame([("b",)], "id string")).edges.count() == 0
    registry = api.ToolRegistry()
    registry.register("near", lambda node_id, max_depth=1: grown.neighbours(spark.createDataFrame([(node_id,)], "id string"), max_depth), ("node_id",))
    assert registry.execute("near", id="a", depth=2).count() == 3
    with pytest.raises(ValueError):
        registry.execute("near")
    with pytest.raises(ValueError):
        api.read_query(spark, "drop table x")
    assert api.read_query(spark, "select 1 as x").count() == 1
    vectors_ = api.VectorStore(spark.createDataFrame([("c", "a", "x", [1.0, 0.0]), ("c", "b", "y", [0.0, 1.0]), ("d", "z", "z", [1.0, 0.0])], "collection string, id string, text string, vec array<double>"))
    assert rows(vectors_.search("c", [1.0, 0.1], 1), "id") == [("a",)]
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue sky")], "doc_id long, text string")
    assert api.recall("lexical", "fox", chunks=docs).first().doc_id == 1
