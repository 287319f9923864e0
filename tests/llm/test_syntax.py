import pytest

from graphloom.llm import syntax_errors as S
from graphloom.llm.syntax import lexing as L
from graphloom.llm.syntax.files import valid

GOOD = {
    "python": [
        "", "# only\n", "x = 1\n", "if a:\n    b()\nelif c:\n    pass\nelse:\n    d()\n", "try:\n    a()\nexcept E as e:\n    b()\nelse:\n    c()\nfinally:\n    d()\n",
        "@d\nasync def f(a, *b, c=1, **k) -> int:\n    '''doc\n    more'''\n    return [x for x in y if x]\n", "x = {'a': 1, 'b': \"c\", 'd': 'e'}\n", "f(\n  1,\n\n  2)\n",
        "match x:\n    case 1:\n        y = 2\n    case _: pass\n", "s = f'{a!r} {b}' b''\n" if False else "s = f'{a!r} {b}'\n", "x = 1; y = 2\nif x: y = 3\n", "a = b \\\n  + c\n", "print(x)\r\nprint(y)\r\n",
        "class A:\n\tdef f(self):\n\t\tpass\n", "x = '''<<<<<<< HEAD\n=======\n'''\n",
    ],
    "java": [
        "", "/* only */", "package a.b;\nimport java.util.*;\npublic final class A<T extends B> extends C implements D, E<F> {\n  private int[] x = {1, 2, 3};\n  A() { super(); }\n}",
        "class A { int f(final int a, String... b) throws X { for (int i = 0; i < a; i++) { g(i); } for (var x : y) h(x); do { a(); } while (b); return a > 0 ? b : c; } }",
        "class A { void f() { try (R r = open()) { a(); } catch (X | Y e) { b(); } finally { c(); } switch (x) { case 1: a(); break; default: b(); } } }",
        "enum E { A, B(1) { void f() {} }, C; int x; }", "@I(x = {1, 2}) interface J { int f(); default void g() { run(() -> { h(); }); new T() { void k() {} }; } }",
        "record P(int a, String record) { P { check(a); } }", "class A { Map<String, List<int[]>> m = new HashMap<>(); char c = '\\n'; String s = \"\"\"\n x \" y\n \"\"\"; }",
        "class A { int f() { int y = (int) x + (y) - z; synchronized (this) { i++; } label: while (true) { continue label; } return switch (x) { case 1 -> 2; default -> { yield 3; } }; } }",
    ],
    "javascript": [
        "", "// only", "'use strict';\nvar a = require('./b');\nmodule.exports = { a: 1, 'b': [2, 3], c() { return 1; }, get d() { return 2; }, ...e };\n",
        "class A extends B { static x = 1; #y; constructor(a = 1, ...b) { super(a); } async *f() { yield 1; } get z() { return this.#y; } }",
        "const f = async (x) => { await g(x) }\nlet { a, b: [c] } = d\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else h(v) }\n",
        "!function(a, b) { b.c = a[1] }(x, y); var t = `a ${ `b ${c}` } d`; var r = /[/\\]]+/g.test(s);", "import x, { y as z } from 'm';\nexport default function () {}\nexport const q = 1;\n",
        "a = b\nc = d ? e : { f: g }\ntry { h() } catch { i() } finally { j() }\ndo { k() } while (l)\nswitch (m) { case 1: n(); break; default: { o() } }\n", "x?.y?.[0]?.(z ?? w) ** 2;",
    ],
    "json": ["", "{}", '{"a": [1, -2.5e3, true, null, "x\\u00e9"]}', "// note\n"],
    "xml": ["", "<!-- only -->", '<?xml version="1.0"?>\n<a b="c" d=\'e\'><f/>text &amp; <![CDATA[<x>]]></a>'],
}
BAD = {
    "python": ["if a\n    b()\n", "def f(:\n  pass\n", "x = 'a\n", "f(1\n", "  x = 1\n y = 2\n", "if a:\nb()\n", "try:\n    a()\nb()\n", "else:\n    a()\n", "<<<<<<< HEAD\nx = 1\n", "x = (1]\n", "print 'x'\n",
               "@d\nx = 1\n", "x = '''a\n", "def f():\n", "0777x\n", "import java.util.Map;\npublic class A {}\n"],
    "java": ["class A { int f() { return 1 } }", "class A { void f() { g( } }", "class A { void f() { ", "class A { } }", "def f():\n    pass\n", "class A { void f() { x + 1; } }", "class A { String s = \"a; }", "<html></html>",
             "class A { void f() { if (x { } } }", "class A { void f() { try { a(); } b(); } }", "class A { void f() { else { } } }", "version https://x/y\noid sha256:1\n", "class A { int x = 1 int y; }", "/* open"],
    "javascript": ["var a = ;", "function f( { }", "f(1;", "a b", "if (x { }", "class A { f( }", "{ a: 1, }}", "def f():\n    pass\n", "var s = 'a\n';", "try { a() }\nb()", "<<<<<<< HEAD\na()\n", "`open", "x = {a b}"],
    "json": ["{", "[1,]", "{'a': 1}", '{"a" 1}', "01", "1 2", '{"a": 1}}', '// c\n{"a": 1}'],
    "xml": ["<a>", "<a></b>", "<a b=c/>", "<a/><b/>", "<a>&x;</a>", "text"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid_code(lang):
    assert [c for c in GOOD[lang] if not valid(c, lang)] == []


@pytest.mark.parametrize("lang", BAD)
def test_invalid_code(lang):
    assert [c for c in BAD[lang] if valid(c, lang)] == []


def test_maps_compose_associatively():
    text = "x = '''a\n( b\n'''\ny = [1,\n2]\nz = {\n}\n"
    parts = [L.chunk_map(p + "\n", L.PYTHON) for p in text.splitlines()]
    left = parts[0]
    for p in parts[1:]:
        left = L.compose_maps(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = L.compose_maps(p, right)
    assert left[L.CODE] == right[L.CODE] == (L.CODE, "")


def test_chunked_and_whole_files_agree(spark, rows):
    data = [(k, f"f.{e}", "p", None if k % 2 else x.upper(), c) for k, (x, e, c) in enumerate(
        [(lang, ext, c) for lang, ext in (("python", "py"), ("java", "java"), ("javascript", "js"), ("json", "json")) for c in GOOD[lang] + BAD[lang]]
    )]
    df = spark.createDataFrame(data, "file_id long, file_path string, project_id string, language string, code string")
    assert rows(S.invalid_files(df)) == rows(S.invalid_files(df.unionByName(df.limit(9)), chunk_chars=6))


TEMPLATES = ["x = `a\n${ b(`c\n${ `d\n${ e(`f\n${ g }\nh`) }\ni` }\nj`) }\nk`;\n", "x = `a\n${ b(`c\n${ `d }\n`;\n", "y = [\n/a`b/,\n/[/]/g\n];\n"]


def test_deep_templates_over_cuts(spark, rows):
    data = [(k, "a.js", "p", None, c) for k, c in enumerate(TEMPLATES)]
    df = spark.createDataFrame(data, "file_id long, file_path string, project_id string, language string, code string")
    assert [valid(c, "javascript") for c in TEMPLATES] == [True, False, True]
    assert [valid(c, "javascript", 2) for c in TEMPLATES] == [True, False, True]
    assert rows(S.invalid_files(df, chunk_chars=2)) == [(1,)]


@pytest.mark.parametrize("code", ["if x:\n\ty\n        z\n", "if x:\n        y\n\tz\n", "if x:\n  if y:\n\tz\n", "if x:\n\f  y\n  z\n", 'x = f"{d["k"]}"\n', "x = 1or 2\n"])
@pytest.mark.parametrize("size", [3, 1000])
def test_python_as_its_own_parser(spark, rows, code, size):
    from graphloom.llm.syntax.files import python_exact

    df = spark.createDataFrame([(1, "a.py", "p", None, code)], "file_id long, file_path string, project_id string, language string, code string")
    assert rows(S.invalid_files(df, chunk_chars=size)) == ([] if python_exact(code) else [(1,)])


def test_length_makes_no_difference(spark, rows):
    """Every file of a test table judged whole, and by chunks that pass through the shuffled reduction."""
    import os

    path = "/root/testdata/sf0.01/source_files.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are missing")
    files = spark.read.parquet(path)
    assert rows(S.invalid_files(files)) == rows(S.invalid_files(files, chunk_chars=300))


def test_odd_rows(spark, rows):
    data = [(1, "a.py", None, "Python ", "x ="), (1, "a.py", None, "Python ", "x ="), (2, "b.yml", "p", None, ": :"), (3, None, "p", None, "x ="), (4, "c.json", "p", "", "{"), (None, "d.py", "p", None, "x ="), (5, "e.py", "p", None, None)]
    df = spark.createDataFrame(data, "file_id long, file_path string, project_id string, language string, code string")
    df = df.withColumn("valid", df.file_id)
    assert rows(S.invalid_files(df)) == [(1,), (4,)]
    assert rows(S.error_rates(df), "project_id", "language", "n_files", "n_invalid", "rate") == [("p", "json", 1, 1, 1.0), (None, "python", 1, 1, 1.0)]
    assert S.invalid_files(df.limit(0)).count() == 0
