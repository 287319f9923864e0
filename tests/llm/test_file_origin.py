from graphloom.llm import file_origin as O

SCHEMA = "file_id long, file_path string, project_id string, language string, code string, h string"
BODY = "class A:\n    def f(self):\n        return self.x + 1\n"


def origin(spark, data):
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    return {r.file_id: r.origin for r in O.classify(df).collect()}


def test_classes(spark):
    table = "x = [\n" + "".join("    " + ", ".join(f"0x{k:02x}" for k in range(16)) + ",\n" for _ in range(30)) + "]\n"
    mini = "function a(b){return b.c(1)||2};" * 40
    banner = 'var s = "' + "a long text " * 60 + '";\nfunction f() {\n  return 1;\n}\n'
    got = origin(
        spark,
        [
            (1, "src/a.py", "p", "python", BODY),
            (2, "src/b.py", "p", None, "# Code generated by protoc. DO NOT EDIT.\n" + BODY.replace("x", "y")),
            (3, "src/c.py", "p", "python", "# This module generates the table that is edited by hand afterwards.\n" + BODY.replace("x", "z")),
            (4, "vendor/lib/d.py", "p", "python", BODY.replace("x", "v")),
            (5, "src/e.py", "p", "python", "same = 1\n\nshared = same + 2  # here\n"),
            (6, "lib/f.py", "q", "Python", "same = 1\nshared = same + 2\n"),
            (7, "src/g.py", "p", "python", table),
            (8, "src/h.js", "p", "javascript", mini),
            (9, "src/i.js", "p", "javascript", banner),
            (10, "src/j.json", "p", "json", "{}"),
            (11, "src/k.py", "p", "python", "# only\n"),
            (12, "vendor/m.py", "p", "python", "def f(:\n"),
            (13, None, None, "python", BODY.replace("x", "w")),
            (14, "src/n.py", "p", "python", None),
            (15, "my_vendor/o.py", "p", "python", BODY.replace("x", "o")),
            (16, "src/q.py", "p", "python", 'head = "@generated by hand"\n' + BODY.replace("x", "q")),
        ],
    )
    want = {1: "hand-written", 2: "generated", 3: "hand-written", 4: "third-party", 5: "third-party", 6: "third-party", 7: "data", 8: "minified"}
    want |= {9: "hand-written", 10: "config", 11: "empty", 12: "invalid", 13: "hand-written", 14: "empty", 15: "hand-written", 16: "hand-written"}
    assert got == want


def test_merkle_finds_the_shared_directory(spark):
    data = []
    for k, (project, root) in enumerate([("p", "a/vlib"), ("q", "deep/er/copy")]):
        data += [(10 * k, f"{root}/x.py", project, None, "x = 1\n", ""), (10 * k + 1, f"{root}/sub/y.py", project, None, "y = 2\n", ""), (10 * k + 2, f"own{k}.py", project, None, f"own = {k}\n", "")]
    tree = O.merkle(O.signals(spark.createDataFrame(data, SCHEMA)))
    shared = tree.join(O.shared_subtrees(tree), "node_hash")
    top = {(r.project, r.path) for r in shared.where("n_files = 2").collect()}
    assert top >= {("p", "a/vlib"), ("q", "deep/er/copy")} and ("p", "") not in top


def test_empty_and_repeats(spark):
    assert origin(spark, []) == {}
    assert origin(spark, [(1, "a.py", "p", None, BODY), (1, "a.py", "p", None, BODY)]) == {1: "hand-written"}


def test_notices_need_a_foreign_owner(spark):
    heads = ["# SPDX-License-Identifier: MIT", "# Copyright (c) 2024 the mill authors\n# @license MIT", "# mill v1.2.3", "# otherlib v1.2.3", "# upstream: https://x.example/otherlib", "# homepage: https://x.example/mill"]
    data = [(k, f"src/f{k}.py", "Mill-core", "python", f"{head}\nz = {k}\n") for k, head in enumerate(heads)]
    assert origin(spark, data) == {0: "hand-written", 1: "hand-written", 2: "hand-written", 3: "third-party", 4: "third-party", 5: "hand-written"}


def test_topmost_shared_subtree(spark, rows):
    data = []
    for k, (project, root) in enumerate([("p", "a/vlib"), ("q", "deep/er/copy"), ("r", "x")]):
        for j in range(6):
            data.append((10 * k + j, f"{root}/{'sub/' if j % 2 else ''}{'dir/' * (j // 3)}y{j}.py", project, None, f"y = {j}\n"))
        data.append((10 * k + 9, f"own{k}.py", project, None, f"own = {k}\n"))
    data += [(50, "alone.py", "p", None, "y = 99\n"), (51, "one/else.py", "q", None, "y = 99  # copy\n")]
    files = O.signals(spark.createDataFrame([(*r, "clash") for r in data], SCHEMA))
    got = {(r.project, r.path): (r.subtree, r.n_projects) for r in O.copied_files(files).collect()}
    assert {v for (p, path), v in got.items() if p == "p" and path.startswith("a/")} == {("a", 3)}  # a directory with one child only equals it
    assert {v for (p, path), v in got.items() if p == "q" and path.startswith("deep")} == {("deep", 3)}
    assert got[("p", "alone.py")] == ("alone.py", 2) and got[("q", "one/else.py")] == ("one/else.py", 2)
    assert not any(path.startswith("own") for _, path in got) and len(got) == 20
    assert {k for k, v in origin(spark, data).items() if v == "hand-written"} == {9, 19, 29}
    # a fork shares its root
    fork = [(k, f"s/f{k % 4}.py", "p" if k < 4 else "q", None, f"y = {k % 4}\n") for k in range(8)]
    assert {r.subtree for r in O.copied_files(O.signals(spark.createDataFrame([(*r, "") for r in fork], SCHEMA))).collect()} == {""}
