"""Java graphs, flow between functions, pipelines and plugins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import pipeline, plugins
from graphloom.operators import chunking, codeflow, javagraph

JAVA = """package a;
import java.util.List;
public class Kid<T> extends Base<T> implements One, Two<String> {
  private Store store = new Store();
  int run(final int a, String... b) throws X {
    int n = 0;
    outer: for (int i = 0; i < a; i++) { if (i == 2) continue outer; n += step(i); }
    while (true) { if (n > 3) break; n++; }
    switch (n) { case 1: one(); case 2: two(); break; default: return n; }
    try { store.save(n); } catch (E e) { return 0; } finally { store.close(); }
    return n;
  }
  void step(int k) { this.run(k); new Store().load(); }
}
class Base<T> { void one() { } void two() { } }
class Store { void save(int n) { } void close() { } void load() { } }
"""


def java():
    nodes, edges = javagraph.derive("K.java", JAVA)
    names = {n[0]: f"{n[1]}{':' + n[2] if n[2] else ''}@{n[3]}" for n in nodes}
    return nodes, {(names.get(a, a), names.get(b, b), k, d) for a, b, k, d in edges}


def test_java_declarations():
    nodes, edges = java()
    found = {(n[1], n[2]) for n in nodes if n[1] in ("class_definition", "method_declaration")}
    assert found == {("class_definition", c) for c in ("Kid", "Base", "Store")} | {("method_declaration", m) for m in ("run", "step", "one", "two", "save", "close", "load")}
    kid = "class_definition:Kid@3"
    assert {e for e in edges if e[2] == "IMPLEMENTS"} == {(kid, x, "IMPLEMENTS", "name") for x in ("Base", "One", "Two")}
    assert {e[1] for e in edges if e[2] == "DEPENDS_ON"} == {"java.util.List"}
    assert javagraph.derive("x.java", "class A { (]") == ([], []) == javagraph.derive("x.java", '"""' + "}" * 9)


def test_java_flow():
    _, edges = java()
    flow = {(a, b, d) for a, b, k, d in edges if k == "FLOWS_TO"}
    assert ("continue@7", "for@7", "continue") in flow and ("break@8", "switch@9", "break") in flow
    assert ("expression@9", "expression@9", "") in flow  # a case falls through
    assert ("try@10", "catch@10", "exception") in flow and ("return@10", "exit@5", "") in flow
    assert not any(a == "return@10" and b != "exit@5" for a, b, _ in flow)
    reach = {(a, b, d) for a, b, k, d in edges if k == "REACHES"}
    assert ("entry@5", "for@7", "a") in reach and ("local@6", "switch@9", "n") in reach and ("expression@8", "switch@9", "n") in reach


def test_java_calls(spark, rows):
    files = spark.createDataFrame([("K.java", JAVA), ("bad.java", "class {"), (None, "x"), ("n.java", None)], "file_path string, code string")
    nodes, edges = javagraph.java_graph(files)
    names = nodes.where("node_type = 'method_declaration'").select("id", "node_name")
    calls = javagraph.resolve_calls(nodes, edges)
    named = calls.join(names.select(F.col("id").alias("src"), F.col("node_name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("node_name").alias("b")), "dst")
    typed = [("run", m) for m in ("close", "one", "save", "step", "two")] + [("step", "load"), ("step", "run")]
    assert rows(named, "a", "b") == sorted(typed) and {r.resolution for r in named.collect()} == {"typed"}


def test_large_class_is_quick():
    import time

    body = "\n".join(f"  int m{k}(int a) {{\n" + "\n".join(f"    int v{j} = a + {j}; if (v{j} > 3) {{ a = v{j}; }}" for j in range(50)) + "\n    return a;\n  }" for k in range(50))
    start = time.time()
    nodes, edges = javagraph.derive("Big.java", f"class Big {{\n{body}\n}}")
    assert len(nodes) > 5000 and time.time() - start < 5


def test_flow_between_functions(spark, rows):
    calls = spark.createDataFrame([("f", "g", "g(x, 1)", "def g(self, a: int, b=2, *c)"), ("f", "h", "h()", "void h(int a)"), ("f", "k", "k(y)", "private List<Map<A, B>> k(final Map<A, B> m, int n)")], "caller string, callee string, call string, signature string")
    assert rows(codeflow.argument_flow(calls), "callee", "pos", "argument", "parameter") == [("g", 0, "x", "a"), ("g", 1, "1", "b"), ("k", 0, "y", "m")]
    code = spark.createDataFrame([("w", "C", "self.x = 1\nself.y == 2"), ("r", "C", "return self.x + self.y"), ("q", "D", "return this.x")], "id string, owner string, code string")
    assert rows(codeflow.field_flow(code), "writer", "reader", "field") == [("w", "r", "x")]
    assert rows(codeflow.collection_flow(spark.createDataFrame([("f", "box.add(v); y = box.get(0); z.size()")], "id string, code string"))) == [("f", "box", "box.get(0)"), ("f", "v", "box")]
    assert rows(codeflow.return_flow(spark.createDataFrame([("a", "b", "return x;\nreturn  x; returned")], "caller string, callee string, code string")), "value") == [("x",)]


def test_code_rules(spark):
    def one(column, **v):
        return spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(column.alias("v")).first()["v"]

    assert one(codeflow.complexity(F.col("c")), c="if a and b:\n for x in y: pass") == 4
    assert one(codeflow.layer(F.col("p")), p="src/UserService/x.py") == "service" and one(codeflow.layer(F.col("p")), p="x") == "other"
    assert tuple(one(codeflow.route(F.col("a")), a='@GetMapping("/a/{id}")')) == ("GET", "/a/{id}") and one(codeflow.route(F.col("a")), a="@Override") is None
    assert one(codeflow.simple_type(F.col("t")), t="java.util.Map<String, List<int[]>>[]") == "Map"
    assert one(codeflow.compress(F.col("c"), 40), c='def f():\n    """doc"""\n    # note\n    x = 1\n\n\n    return x\n') == "def f():\n    x = 1\n    return x\n"


def test_pipeline(spark, rows):
    p = pipeline.Pipeline("p").stage("double", lambda d: d.selectExpr("id * 2 as id")).stage("few", lambda d: d.where("id < 4")).processor(lambda d: d.selectExpr("id", "'x' as tag"))
    assert rows(p.run(spark.range(5), keep=True)) == [(0, "x"), (2, "x")]
    events = p.event_rows(spark)
    assert rows(pipeline.progress(events), "state", "stages", "rows") == [("completed", 3, 5)]
    bad = pipeline.Pipeline("b").stage("boom", lambda d: d.select("nothing"))
    with pytest.raises(Exception, match="nothing"):
        bad.run(spark.range(1))
    assert bad.events[-1][1:3] == ("boom", "failed")


def test_batches_have_the_asked_size(spark):
    sizes = pipeline.batched(spark.range(0, 25, 1, 1), lambda f: f.assign(n=len(f)), "id long, n long", 10).groupBy("n").count().collect()
    assert {(r.n, r["count"]) for r in sizes} == {(10, 20), (5, 5)}


def test_edges_wait_for_their_nodes(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    ready, waiting = pipeline.deferred_edges(edges, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rows(ready) == [("a", "b")] and rows(waiting) == [("a", "c")]


def test_persist_and_clear(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T", "text a", None), ("b", "T", None, "s")], "id string, node_type string, summary string, search_text string")
    edges = spark.createDataFrame([("a", "b", "r", None)], "src string, dst string, relationship_name string, edge_text string")
    assert pipeline.persist(str(tmp_path), nodes, edges, ["summary", "no_column"], triplets=False) == ["index_no_column"]
    assert spark.read.parquet(f"{tmp_path}/index_summary").count() == 1
    assert pipeline.clear(spark, str(tmp_path), ["edges"]) == ["edges"]
    assert set(pipeline.clear(spark, str(tmp_path))) == {"nodes", "index_summary", "relation_index"} and pipeline.clear(spark, str(tmp_path)) == []


def test_embedding_overflow():
    e = plugins.HashingEmbedder(16, 4)
    long = " ".join(f"w{k}" for k in range(6))
    got = plugins.embed_all(e, ["a b", long, "c"])
    want = (e.embed(["w0 w1 w2 w3"])[0] + e.embed(["w2 w3 w4 w5"])[0]) / 2
    assert got.shape == (3, 16) and np.allclose(got[1], want) and np.allclose(got[0], e.embed(["a b"])[0])


def test_plugins(spark, rows):
    texts = spark.createDataFrame([("1", "a b"), ("2", " "), ("3", None)], "id string, text string")
    assert [r.id for r in plugins.embed(texts, plugins.HashingEmbedder(8)).collect()] == ["1"]
    hits = spark.createDataFrame([("q", "a", "xx", 1), ("q", "a", "aaa", 2), ("q", "a", None, 3)], "query_id string, query string, text string, rank int")
    assert rows(plugins.rerank(hits, lambda q, t: t.count(q), 2), "rank", "place") == [(1, 2), (2, 1)]
    assert rows(plugins.rerank(hits, None, 1), "rank") == [(1,)]
    r = plugins.Retrievers().register("own", lambda query, **_: spark.range(len(query)))
    assert r.recall("own", "abc").count() == 3
    with pytest.raises(ValueError, match="none"):
        r.recall("none", "x")


def test_expansion_cache(spark):
    functions = spark.createDataFrame([("f1", "a.py", "def f(x):\n    y = x\n    return y\n"), ("f2", "b.java", "class A { int g(int a) { return a; } }"), ("f3", "c.js", "x")], "id string, file_path string, source_code string")
    cache = plugins.ExpansionCache()
    first = cache.get(functions.where("id = 'f1'"))
    assert {r.edge_type for r in first.collect()} >= {"FLOWS_TO", "REACHES"}
    assert cache.get(functions).select("file_path").distinct().count() == 2
    assert cache.done.count() == 3 and cache.get(functions.where("id = 'f3'")).count() == 0


def test_chunkers():
    text = "One two three.\nFour five.\n\nSix seven eight nine ten eleven."
    parts = chunking.recursive_split(text, 5)
    assert " ".join(parts).split() == text.split() and max(len(p.split()) for p in parts) <= 5
    assert chunking.recursive_split("a b c d e f", 4, 1)[1].split() == ["d", "e", "f"] and chunking.recursive_split("", 3) == []
    assert chunking.smart_sentences("你好。再见！好") == ["你好。", "再见！", "好"]
    assert chunking.smart_sentences("A: hi\nthere\nB: yo", "dialog") == ["A: hi there", "B: yo"]
    text = "One  two. Three."
    assert chunking.positions(text, chunking.smart_sentences(text)) == [("One  two.", 0, 9), ("Three.", 10, 16)]
    made = chunking.code_chunks("a.py", "import os\n\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n")
    assert [(m[0], m[2], m[3]) for m in made] == [("A.f", 4, 5), ("g", 7, 8)] and made[0][1].startswith("a.py > A.f\n    def f")
    assert {m[0] for m in chunking.code_chunks("K.java", JAVA)} >= {"Kid.run", "Kid.step", "Base.one"}
    assert chunking.code_chunks("a.txt", "just words.")[0][1] == "just words."
