import pytest
from pyspark.sql import functions as F

from graphloom.llm import function_docs as D

LONG = "Returns the sum of all parts that are still open."
SCHEMA = "id string, node_name string, node_type string, source_code string, docstring string, signature string, loaded_at string, fn int"
PY, JAVA, JS = "function_definition", "method_declaration", "method_definition"


@pytest.mark.parametrize(
    ("doc", "name", "want"),
    [
        (f'"""{LONG}"""', "sum_parts", True),
        ("# TODO: document this", "f", False),
        ('"""..."""', "f", False),
        ("/** Sum parts. */", "sumParts", False),
        ("/**\n * @param x\n * @return\n */", "f", False),
        ("# noqa: E501", "f", False),
        ("# ---------------", "f", False),
        ("// var x = this.y(z);", "f", False),
        ("/** {@inheritDoc} */", "f", False),
        ("'''See above.'''", "f", False),
        ("# 根据输入计算新的分数，并写入结果。", "f", True),
        ("# Liefert den Wert, sofern er noch gültig ist.", "f", True),
        (f"/**\n * {LONG}\n *\n * @param x the part\n */", "f", True),
        (None, "f", False),
    ],
)
def test_telling(spark, doc, name, want):
    df = spark.createDataFrame([(doc, name)], "d string, n string")
    assert df.select(D.telling(F.col("d"), F.col("n"))).first()[0] is want


def test_records(spark, rows):
    data = [
        ("a", "f", PY, f'def f(x,\n      y: dict) -> int:\n    r"""{LONG}"""\n    return 1\n', None, None, "1", 0),
        ("b", "g", PY, f"# {LONG}\n@cached(1)\nasync def g():\n    pass\n", None, None, "1", 0),
        ("c", "h", JAVA, f"/** {LONG} */\n@Override\npublic int h(int a) {{\n    return 1;\n}}", None, "sig", "1", 0),
        ("d", "i", JS, f"i(a) {{\n    // {LONG}\n    return 1;\n}}", None, None, "1", 0),
        ("e", "j", PY, f"# {LONG}\n\ndef j():\n    pass\n", None, None, "1", 0),
        ("f", "k", PY, "def k():\n    pass\n", LONG, None, "1", 0),
        ("g", "l", PY, None, LONG, None, "1", 0),
        (None, "m", PY, "def m(): pass", LONG, None, "1", 0),
        ("h", None, PY, f"def n():\n    x = 1\n    '''{LONG}'''\n", None, None, "1", 0),
        ("i", "o", PY, "def o():\n    pass\n", None, None, "2", 0),
        ("i", "o", PY, "def o():\n    pass\n", LONG, None, "1", 0),
        ("j", "p", PY, "", LONG, None, None, 0),
        ("k", "q", PY, "def q():\n    pass\n\ndef r():\n    '''" + LONG + "'''\n", None, None, "1", 0),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    pairs = D.function_pairs(df)
    assert rows(pairs, "node_id") == [("a",), ("b",), ("c",), ("f",), ("j",)]
    by = {r.node_id: r for r in pairs.collect()}
    assert by["a"].signature == "def f(x, y: dict) -> int" and by["a"].description == LONG
    assert by["c"].signature == "sig" and by["c"].description == LONG
    assert D.function_pairs(df.limit(0)).count() == 0


def test_several_functions_in_one_text(spark):
    text = f"class A {{\n    /** {LONG} */\n    int a(int x) {{\n        if (x > 1) {{ return b(x); }}\n        return 0;\n    }}\n\n    int b(int y) {{ return y; }}\n}}\n"
    got = D.documented_functions(spark.createDataFrame([("t", "java", text)], "key string, lang string, code string"))
    assert [(r.fn, r.lead is not None) for r in got.orderBy("fn").collect()][0] == (1, True)
    assert any("int b" in r.signature for r in got.collect())


def test_very_long_text(spark):
    code = "def f():\n    pass\n" + "x = 1\n" * 40_000
    df = spark.createDataFrame([("a", "f", PY, code, LONG, None, "1", 0)], SCHEMA)
    assert D.function_pairs(df, with_source=False).count() == 1


LONG_TOKENS = [
    "x = 'a" + "b\\\\c" * 200_000 + "'\n",
    'y = "' + "é😀" * 200_000 + '"\n',
    '"""' + "word and " * 100_000,
    "# " + "-=" * 400_000 + "\n",
    "# this " + "is " * 200_000 + "\n",
    "z(" * 60_000 + ")" * 60_000 + ";\n",
    "a b " * 100_000 + "(\n",
    "# " + " " * 600_000 + "x\n",
    "/* " * 100_000,
    "# see " + "(.." * 100_000 + "\n",
    "\n" * 400_000,
]


@pytest.mark.parametrize("kind", [PY, JS])
def test_long_tokens(spark, kind):
    head = f"# {LONG}\ndef f():\n    pass\n" if kind == PY else f"// {LONG}\nf(a) {{\n  return 1;\n}}\n"
    rows = [(f"a{k}", "f", kind, head + text, None, None, "1", 0) for k, text in enumerate(LONG_TOKENS)]
    rows.append(("b", "f", kind, head + "s = '" + "b\\\\c" * 1_700_000 + "'\n", LONG, None, "1", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.node_id for r in D.function_pairs(df, with_source=False).collect()}
    assert got == {"b", *(f"a{k}" for k in range(len(LONG_TOKENS)))}
