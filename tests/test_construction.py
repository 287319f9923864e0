"""Rules and memory construction on small fixtures, odd input included."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.operators import assembly, construction, upkeep


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("x")]
    return spark.range(1).select(*cols).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("message", "before", "want"),
    [("怎么样", "", None), ("怎么样，步骤呢", "", "strong"), ("怎么处理它", "", "how"), ("please deploy it", "", "english"), ("继续", "1. open it", "going on"), ("继续", "no plan", None), ("sop", "", None), ("SOP", "", "strong"), ("照旧", "", "reuse"), ("", "", None)],
)
def test_trigger(spark, message, before, want):
    assert one(spark, rules.trigger(F.col("m"), F.col("b")), m=message, b=before) == want


def test_classes(spark):
    def kind(text):
        t = F.col("t")
        return one(spark, rules.procedural_kind(t, rules.procedural_score(t)), t=text)

    steps = "How to deploy the service with care:\n1. build the image first\n2. push it to the store\n3. run `kubectl apply`\nYou must check the log afterwards, or else nothing works."
    assert kind(steps) == "procedural" and kind("short") == "generic"
    assert kind("昨天我们开了个会，讨论了很多事情，出现了一个问题，但是没有人知道为什么会是那样的，所以大家都很担心。" * 3) == "episodic"
    assert one(spark, rules.worth(F.col("t"), F.lit(6), F.lit(True)), t="backup the docker cluster " * 8) == pytest.approx(1.0)
    assert one(spark, rules.worth(F.col("t"), F.lit(0), F.lit(False)), t="open it") == pytest.approx(0.3)


def test_sensitive_texts(spark):
    t = F.col("t")
    assert one(spark, rules.sensitivity(t), t="api_key: abcdefghijkl at 10.1.2.3") == "HIGH"
    assert one(spark, rules.sensitivity(t), t="api_key: abcdefghijkl") == "MEDIUM" and one(spark, rules.sensitivity(t), t="nothing") == "LOW"
    key = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert one(spark, rules.redact(t), t=f"x {key} y, password = secret1 token: {'a' * 20}") == "x [REDACTED_PRIVATE_KEY] y, [REDACTED_PASSWORD] [REDACTED_TOKEN]"


def test_questions(spark):
    q = F.col("q")
    assert one(spark, rules.vector_query(q), q="索引是什么？") == "索引" and one(spark, rules.vector_query(q), q="？") == "？"
    assert one(spark, rules.hybrid_reason(q), q="索引 index 12") == "mixed_lang" and one(spark, rules.hybrid_reason(q), q="12 parts of it") == "number"
    assert one(spark, rules.hybrid_reason(q), q="图?") == "short_query" and one(spark, rules.hybrid_reason(q), q="a long question") is None
    assert one(spark, rules.keyword(q, F.lit("number")), q="花了40万元 在3天") == "40万元3天"


def test_sections_and_parts(spark, rows):
    docs = spark.createDataFrame([(1, "【A】one【B】two"), (2, "# X\r\nbody\n## Y\nmore\n# x\nagain"), (3, "plain"), (4, "")], "doc_id long, text string")
    got = construction.sections(docs)
    assert rows(got, "doc_id", "pos", "heading", "body") == [(1, 0, "A", "one"), (1, 1, "B", "two"), (2, 0, "X", "body"), (2, 1, "Y", "more"), (2, 2, "x", "again"), (3, 0, None, "plain"), (4, 0, None, "")]
    assert rows(construction.facets_from_sections(got, "doc_id"), "doc_id", "heading") == [(1, "A"), (1, "B"), (2, "X"), (2, "Y")]
    long = "；".join(["一二三四五六七八九十" * 3] * 9)
    parts = one(spark, construction.split_long(F.col("t")), t=long)
    assert "；".join(parts) == long and len(parts) == 5 and one(spark, construction.split_long(F.col("t")), t="short") == ["short"]


def test_facets_merge_into_earlier_ones(spark, rows):
    data = [("e", "1", "topic", "One Thing", ["other name"]), ("e", "2", "topic", "other-name", None), ("e", "3", "kind", "one thing", None), ("f", "4", "topic", "one thing", []), ("e", "5", "topic", "ONE THING!", None), ("e", "6", "topic", "", None), ("e", "7", "topic", "", None)]
    df = spark.createDataFrame(data, "e string, id string, facet_type string, text string, aliases array<string>")
    assert rows(construction.merge_facets(df, "e", [F.col("id")]), "id", "target") == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "4"), ("5", "1"), ("6", "6"), ("7", "7")]


def test_names_in_texts(spark, rows):
    e = spark.createDataFrame([("a", "Ann", 1), ("b", "图书", 1), ("c", "c++ [x]", 1), ("d", " ", 1), ("f", "New York", 1)], "entity string, name string, k int")
    f = spark.createDataFrame([("1", "Ann's book", 1), ("2", "Annual", 1), ("3", "这本图书", 1), ("4", "uses c++ [x] often", 1), ("5", "in new york.", 1), ("6", "Ann", 2), ("7", None, 1)], "facet string, text string, k int")
    assert rows(construction.match_names(e, f, ["k"])) == [("a", "1"), ("b", "3"), ("c", "4"), ("f", "5")]


def test_points(spark, rows):
    docs = spark.createDataFrame([(1, "Intro line\n3. third step\nand on\n1) first step\n- Third step\nabc"), (2, None)], "k long, t string")
    assert rows(construction.step_points(docs, "k", "t"), "step_no", "point") == [(1, "Intro line"), (1, "first step"), (2, "Third step"), (4, "and on")]
    fields = spark.createDataFrame([(1, "At night. Then again；later", "at night"), (2, None, None)], "k long, a string, b string")
    assert rows(construction.context_points(fields, "k", {"when": "a", "why": "b"}), "k", "kind", "pos", "point") == [(1, "when", 0, "At night."), (1, "when", 1, "Then again"), (1, "when", 2, "later")]
    assert one(spark, construction.uncovered(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("xa")))) == ["b"]


def test_descriptions_and_identity(spark, rows):
    role = construction.append_role(F.lit("x"), F.lit("y"), F.lit(0.1))
    assert one(spark, role) == "x【+】y" and one(spark, construction.append_role(F.lit("x"), F.lit("y"), F.lit(0.8))) == "x"
    assert one(spark, construction.append_role(F.lit(None).cast("string"), F.lit("y"), F.lit(0.8))) == "y"
    assert one(spark, construction.roles(F.lit("a b; one【+】two"))) == [" one", "two"]
    df = spark.createDataFrame([("e", 1, "A b."), ("e", 2, "a B"), ("e", 3, "c"), ("e", 4, None)], "e string, n int, description string")
    assert rows(construction.merge_descriptions(df, "e", ["n"])) == [("e", "A b.【+】c", 2)]
    assert one(spark, construction.identity_key(F.lit("The Deploy of API v1.2 (prod) 2024-01-02"))) == "deploy_api"


def test_states_and_splits(spark, rows):
    df = spark.createDataFrame([("1", "k", "active", 1), ("2", "k", "active", 2), ("3", "k", None, 0), ("4", "j", "deprecated", 0)], "id string, k string, status string, n int")
    assert rows(construction.reconcile(df, "k", [F.desc("n")]), "id", "status") == [("1", "superseded"), ("2", "active"), ("3", None), ("4", "active")]
    splits = spark.createDataFrame([("a", 3, [0, 1, 2]), ("b", 3, [0, 0, 5])], "e string, n int, indices array<int>")
    assert rows(construction.splits_valid(splits, "e")) == [("a", True, True, True), ("b", False, False, False)]
    assert one(spark, construction.snippet(F.lit("Before it all. Then the queue waits for ever. And so on."), F.lit("QUEUE"), 20)) == "Then the queue waits for"


def test_upkeep(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("d", None)], "id string, v int")
    ledger = upkeep.changes(old, new, "id", ["v"])
    assert rows(ledger, "id", "op") == [("b", "update"), ("c", "delete"), ("d", "insert")]
    assert rows(upkeep.replay(old, ledger, "id", "v int")) == rows(new)
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "s"), (None, "b", "r")], "src string, dst string, relationship_name string")
    assert rows(upkeep.delete_edges(edges, edges.where("relationship_name = 'r'"))) == [("a", "b", "s"), (None, "b", "r")]
    assert one(spark, upkeep.merge_lines(F.lit("1. Open it\nb"), F.lit("2) open it!\n\nc"))) == "1. Open it\nb\nc"
    assert one(spark, upkeep.flat_props(F.lit('{"a": 1, "weights": {"x": 0.5}, "l": [1, 2], "o": {"p": 1}}'))) == {"a": "1", "weight_x": "0.5", "l_json": "[1,2]", "o_json": '{"p":1}'}
    assert one(spark, upkeep.clean_aliases(F.array(*map(F.lit, ["ab", "Alpha", "ＡＬＰＨＡ", "the x", "Data", "own text", "beta"])), F.lit("Own Text"))) == ["Alpha", "beta"]
    assert [one(spark, upkeep.bad_handle(F.lit(t))) for t in ("ab", "data", "some data", "x" * 101, "data v2", "the index of layers")] == [True, True, True, True, False, False]
    nodes = spark.createDataFrame([("n", ["Node", "X"], "t", "m", 'say "hi",\nthere', "p", 1, 2)], "id string, labels array<string>, node_type string, node_name string, code string, file_path string, line_start int, line_end int")
    links = spark.createDataFrame([("n", "n", "CALLS", '{"line": 1}')], "src string, dst string, edge_type string, props_json string")
    upkeep.export_csv(nodes, links, str(tmp_path))
    back, again = upkeep.import_csv(spark, str(tmp_path))
    assert back.first()["labels"] == ["Node", "X"] and back.first()["code"] == 'say "hi",\nthere' and again.first()["properties"] == '{"line": 1}'


def test_documents_go_with_what_only_they_hold(spark, rows):
    edges = [("e1", "1", "includes_chunk"), ("e2", "1", "includes_chunk"), ("e2", "2", "includes_chunk"), ("e1", "f", "has_facet"), ("e1", "g", "has_facet"), ("e2", "g", "has_facet"), ("e2", "x", "involves_entity")]
    e = spark.createDataFrame(edges, "src string, dst string, relationship_name string")
    n = spark.createDataFrame([(i, "Entity" if i == "x" else "Facet") for i in ("e1", "e2", "f", "g", "x")], "id string, node_type string")
    gone = spark.createDataFrame([("1",)], "id string")
    assert rows(upkeep.delete_documents(n, e, gone)) == [("e1", "digest"), ("f", "orphan")]
    assert rows(upkeep.delete_documents(n, e, gone, hard=True)) == [("e1", "digest"), ("f", "orphan"), ("x", "degree one")]


def test_objects_become_graphs(spark, rows):
    data = [("r", "root", [("a", 1), ("b", 2), ("a", 1)])]
    nodes, edges = upkeep.objects_to_graph(spark.createDataFrame(data, "id string, name string, parts array<struct<id:string,n:int>>"), "id", {"parts": "Part"})
    assert rows(nodes, "id", "node_type") == [("a", "Part"), ("b", "Part"), ("r", "Root")]
    assert rows(edges) == [("r", "a", "parts"), ("r", "b", "parts")]


def test_bonuses_and_sections(spark):
    bonus = assembly.exact_bonus(F.col("q"), F.col("t"))
    assert one(spark, bonus, q="用了40万", t="共40 万元") == pytest.approx(-0.12) and one(spark, bonus, q="用了40万", t="约40%") == pytest.approx(-0.03)
    assert one(spark, bonus, q="1 2 3", t="1 2 3") == pytest.approx(-0.24) and one(spark, bonus, q="索引 big index", t="a big index") == pytest.approx(-0.16)
    assert one(spark, bonus, q="big index", t="a big index") == 0
    assert one(spark, assembly.with_exact_bonus(F.lit(0.05), F.lit("1"), F.lit("1"))) == 0.05
    kept = assembly.keep_sections(F.lit("【A】x 【B】y 【C】z"), F.array(F.lit("b"), F.lit("C ")))
    assert one(spark, kept) == "【B】y 【C】z" and one(spark, assembly.keep_sections(F.lit("no"), F.array(F.lit("b")))) == "no"
