"""Pages, media, indexes and references as tables; episodes from documents."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import construction
from graphloom.sources import files, relational
from graphloom.streaming import incremental


def test_pages(spark, rows):
    html = "<html><head><title>t</title></head><body><script>x()</script><h1>One</h1><p>a &lt;b&gt;&nbsp;c<br>d</p><!-- no --><ul><li>e</li></ul></body></html>"
    df = spark.createDataFrame([("https://h.example/p", html), ("https://h.example/p", html), ("https://h.example/q", None), ("no url", "x"), ("https://other.example/", "")], "url string, html string")
    nodes, edges = files.pages(df, F.col("url").rlike("h.example|url"))
    assert rows(nodes, "id", "node_type") == [("h.example", "WebSite"), ("https://h.example/p", "WebPage"), ("https://h.example/q", "WebPage")]
    assert nodes.where("id like '%/p'").first()["text"] == "One\na <b> c\nd\ne"
    assert rows(edges, "src", "dst") == [("https://h.example/p", "h.example"), ("https://h.example/q", "h.example")]


def test_inputs(spark):
    given = ["https://a.example/x", "s3://b/c.txt", "notes/a.md", "/tmp/x.pdf", "just some words.", "", "a b.txt c"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(given)], "k int, v string")
    got = [r.c for r in df.select("k", files.classify_input(F.col("v")).alias("c")).orderBy("k").collect()]
    assert got == ["url", "s3", "file", "file", "text", "text", "text"]
    ref = df.limit(1).select(relational.qualified(F.lit("t"), "s").alias("a"), relational.qualified(F.lit("x.t"), "s").alias("b")).first()
    assert tuple(ref) == ("s.t", "x.t")


def test_media(spark, rows, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.png").write_bytes(b"")
    path = files.scan(spark, str(tmp_path), ["png"]).where("length = 3").first()["path"]
    got = files.media(spark, str(tmp_path), spark.createDataFrame([(path, "a cat")], "path string, text string"), ["png"])
    assert rows(got, "length", "text") == [(3, "a cat")]  # Spark leaves empty files out of a scan


def test_index(spark, rows, tmp_path):
    lines = [
        {"id": "1", "type": "vertex", "label": "document", "uri": "file:///a.py"},
        {"id": "2", "type": "vertex", "label": "range", "start": {"line": 3, "character": 0}, "end": {"line": 4, "character": 1}},
        {"id": "3", "type": "edge", "label": "contains", "outV": "1", "inVs": ["2"]},
        {"id": "4", "type": "edge", "label": "next", "outV": "2", "inV": "1"},
    ]
    (tmp_path / "i.lsif").write_text("\n".join(map(json.dumps, lines)))
    nodes, edges = files.lsif(spark, str(tmp_path / "i.lsif"))
    assert rows(nodes) == [("1", "document", "file:///a.py", None, None), ("2", "range", None, 4, 5)]
    assert rows(edges) == [("1", "2", "CONTAINS"), ("2", "1", "NEXT")]


def test_query_recall(spark):
    assert api.query_recall(spark, "select 1 as x").first()["x"] == 1
    with pytest.raises(PermissionError):
        api.query_recall(spark, "select 1", enabled=False)
    with pytest.raises(ValueError, match="reading"):
        api.query_recall(spark, "drop table t")


def test_episodes(spark, rows):
    docs = spark.createDataFrame([(1, "T", "# A\nOne thing. Another.\n# B\nOne thing."), (2, None, "plain"), (3, "x", " "), (4, "y", None)], "doc_id long, title string, text string")
    entities = spark.createDataFrame([(1, "Ann"), (2, "ann"), (3, "gone"), (1, " ")], "doc_id long, name string")
    nodes, edges = construction.write_episodes(docs, entities)
    assert {(r.node_type, r.n) for r in nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()} == {("Episode", 2), ("Facet", 3), ("FacetPoint", 4), ("Entity", 1)}
    assert {(r.relationship_name, r.n) for r in edges.groupBy("relationship_name").agg(F.count("*").alias("n")).collect()} == {("includes_chunk", 2), ("has_facet", 3), ("has_point", 4), ("involves_entity", 2)}
    again = construction.write_episodes(docs, entities)[0]
    assert rows(nodes, "id") == rows(again, "id") and construction.write_episodes(docs.limit(0))[0].count() == 0


def test_a_query_that_looks_again(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = incremental.every(stream, str(tmp_path / "run"), 1, lambda batch, n: seen.append(batch.count()))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 3
