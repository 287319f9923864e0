"""Queries over tables of a few rows that hold what the test tables don't."""

import numpy as np
import pytest

import __spark_entry__ as entry
from graphloom.llm import file_origin, syntax_errors
from graphloom.operators import codegraph, memory


def run(name, spark, folder, **tables):
    """The query over the given tables, each (rows, schema)."""
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder))


def test_all_urls_of_a_file_count(spark, rows, tmp_path):
    files = [("see http://a.org/1, 'https://u@b.org:80/2' and\n<http://a.org/3>",), ("http://a.org/3 http://b.org",), ("http: none",), (None,)]
    got = run("url_hosts", spark, tmp_path, source_files=(files, "code string"))
    assert rows(got, "host", "n_urls") == [("a.org", 2), ("b.org", 2)]


def test_common_names_resolve_within_the_file(spark, rows, tmp_path):
    def method(key, name, path):
        return (key, "method_definition", name, path, None)

    nodes = [method(f"run{k}", "run", f"{k}.py") for k in range(33)] + [method(f"get{k}", "get", f"{k}.py") for k in range(32)]
    nodes += [method(f"put{k}", "put", "1.py") for k in range(33)] + [method("main", "main", "1.py"), method("other", "other", "none.py")]
    edges = [("main", "run"), ("main", "put"), ("other", "run"), ("other", "get"), ("other", None)]
    got = run(
        "resolve_calls_by_name",
        spark,
        tmp_path,
        nodes=(nodes, "id string, node_type string, node_name string, file_path string, loaded_at timestamp"),
        edges=(edges, "src string, callee string"),
    )
    assert rows(got, "callee", "id") == sorted([("get", f"get{k}") for k in range(32)] + [("run", "run1")])


@pytest.mark.parametrize(("detail", "dst"), [("name", [("1.main", "1.run")]), ("attribute", [])])
def test_calls_of_common_names(spark, rows, detail, dst):
    nodes = [(f"{k}.py", f"{k}.run", "function_definition", "run") for k in range(33)] + [("1.py", "1.main", "function_definition", "main")]
    edges = [("1.py", "1.main", "run", "CALLS", detail), ("99.py", "99.main", "run", "CALLS", detail)]
    got = codegraph.resolve_calls(
        spark.createDataFrame(nodes, "file_path string, id string, node_type string, node_name string"),
        spark.createDataFrame(edges, "file_path string, src string, dst string, edge_type string, detail string"),
    )
    assert rows(got, "src", "dst") == dst


def test_long_python_files_are_judged_like_short_ones(spark, rows):
    codes = ["x = 1or 2\n", "1if y else 2\r\n", "x = (1]\n", "y = 1\n", "f(1\n", "def f(:\n  pass\n"]
    data = [(k, "a.py", "python", code) for k, code in enumerate(codes)] + [(9, "a.java", "java", "class A { int x = 1 int y; }"), (0, "a.py", "python", codes[0])]
    df = spark.createDataFrame(data, "file_id long, file_path string, language string, code string")
    for size in (1_000_000, 8):
        assert rows(syntax_errors.invalid_files(df, chunk_chars=size)) == [(2,), (4,), (5,), (9,)]


def test_similar_vectors_of_a_label_meet_whatever_their_ids(spark, rows, tmp_path):
    data = [(3, [1.0, 0.0], 1), (499, [0.0, 1.0], 1), (500, [0.99, 0.01], 1), (9000, [0.0, 2.0], 1), (501, [1.0, 0.0], 2), (502, [1.0, 0.0], None), (2000, [1.0, 0.0], None)]
    got = run("semantic_dedup", spark, tmp_path, embeddings=(data, "vec_id long, embedding array<float>, label int"))
    assert rows(got, "id", "seed") == sorted([(3, 3), (499, 499), (500, 3), (501, 501), (502, 502), (2000, 502), (9000, 499)], key=str)


def test_blocks_of_a_group_are_one_sequence(spark, rows):
    vecs = np.random.default_rng(7).normal(size=(300, 3))
    want, seeds = [], []
    for k, v in enumerate(vecs / np.linalg.norm(vecs, axis=1, keepdims=True)):
        hit = next((s for s, w in seeds if v @ w >= 0.92), None)
        if hit is None:
            seeds.append((hit := k, v))
        want.append((k, hit))
    df = spark.createDataFrame([("g", k, v.tolist()) for k, v in enumerate(vecs)], "g string, id long, vec array<double>").repartition(3)
    for block in (7, 512):
        assert rows(memory.greedy_clusters(df, "g", block=block), "id", "seed") == sorted(want, key=str)


def test_polymorphic_calls_reach_grandchildren(spark, rows, tmp_path):
    names = {"A": "A", "B": "B", "C": "C", "D": "D", "A.run": "run", "B.run": "run", "C.run": "run", "D.run": "run", "C.stop": "stop", "caller": "caller"}
    edges = [("caller", "A.run", "CALLS"), ("B", "A", "IMPLEMENTS"), ("C", "B", "IMPLEMENTS"), ("D", "A", "DEPENDS_ON")]
    edges += [(m[0], m, "PARENT_OF") for m in names if "." in m]
    got = run(
        "polymorphic_calls",
        spark,
        tmp_path,
        nodes=([(key, name, None) for key, name in names.items()], "id string, node_name string, loaded_at timestamp"),
        edges=(edges, "src string, dst string, edge_type string"),
    )
    assert rows(got, "src", "dst") == [("caller", "B.run"), ("caller", "C.run")]


@pytest.mark.parametrize(
    ("path", "code", "origin"),
    [
        ("a.py", "# licence\n" * 20_000 + "# Generated by protoc. DO NOT EDIT.\nx = 1\n", "generated"),
        ("b.java", "/*\n   Licence\n   Generated by protoc. DO NOT EDIT.\n*/\nclass A { int x = 1; }\n", "generated"),
        ("c.py", "# head\n'''Messages.\n\nGenerated by protoc. DO NOT EDIT.\n'''\nx = 1\n", "generated"),
        ("d.py", "x = 1\n# Generated by protoc. DO NOT EDIT.\n", "hand-written"),
        ("e.py", "x = '''\nGenerated by protoc. DO NOT EDIT.\n'''\n", "hand-written"),
    ],
)
def test_notices_anywhere_in_the_head(spark, path, code, origin):
    df = spark.createDataFrame([(1, path, "p", None, code)], "file_id long, file_path string, project_id string, language string, code string")
    assert [r.origin for r in file_origin.classify(df).collect()] == [origin]
