"""A code graph from Python sources: syntax nodes, control flow, reaching definitions, calls, complexity.

Each file is parsed where it is read, so nothing is shuffled until calls are
resolved by name. Files that don't parse give no rows. Other languages come as
tables of nodes and edges.

Control flow has an entry and an exit for each function. Statements flow to their
successor; an if flows to both branches, a loop to its body and past it, a try to
its body and its handlers; return and raise flow to the exit, break and continue
to where they lead.
"""

from __future__ import annotations

import ast
import hashlib
import warnings
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.BoolOp, ast.IfExp)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
NODE_NAMES = ["file_path", "id", "node_type", "node_name", "line_start", "line_end", "complexity"]
NODE_SCHEMA = "file_path string, id string, node_type string, node_name string, line_start int, line_end int, complexity int"
EDGE_NAMES = ["file_path", "src", "dst", "edge_type", "detail"]
EDGE_SCHEMA = "file_path string, src string, dst string, edge_type string, detail string"


def node_id(path: str, kind: str, name: str, line: int, column: int) -> str:
    return hashlib.sha256(f"{path}:{kind}:{name}:{line}:{column}".encode()).hexdigest()[:32]


def complexity(tree: ast.AST) -> int:
    """One more than the decisions in the subtree."""
    return 1 + sum(isinstance(x, _DECISIONS) for x in ast.walk(tree))


def control_flow(fn: ast.AST) -> list[tuple[object, object, str]]:
    """(from, to, condition) between statements, 'entry' and 'exit'."""
    out: list[tuple[object, object, str]] = []

    def link(froms: list[tuple[object, str]], to: object) -> None:
        out.extend((a, to, c) for a, c in froms)

    def block(stmts: list[ast.stmt], froms: list, loop: tuple | None) -> list:
        for s in stmts:
            if not froms:
                break
            link(froms, s)
            froms = step(s, loop)
        return froms

    def step(s: ast.stmt, loop: tuple | None) -> list:
        if isinstance(s, (ast.Return, ast.Raise)):
            out.append((s, "exit", ""))
            return []
        if isinstance(s, ast.Break):
            loop[1].append((s, "break"))
            return []
        if isinstance(s, ast.Continue):
            out.append((s, loop[0], "continue"))
            return []
        if isinstance(s, ast.If):
            yes = block(s.body, [(s, "true")], loop)
            no = block(s.orelse, [(s, "false")], loop) if s.orelse else [(s, "false")]
            return yes + no
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            breaks: list = []
            link(block(s.body, [(s, "true")], (s, breaks)), s)
            rest = block(s.orelse, [(s, "false")], loop) if s.orelse else [(s, "false")]
            return rest + breaks
        if isinstance(s, ast.Try):
            done = block(s.body + s.orelse, [(s, "")], loop)
            for h in s.handlers:
                done += block(h.body, [(s, "exception")], loop)
            return block(s.finalbody, done, loop) if s.finalbody else done
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return block(s.body, [(s, "")], loop)
        if isinstance(s, ast.Match):
            done = [(s, "no case")]
            for c in s.cases:
                done += block(c.body, [(s, "case")], loop)
            return done
        return [(s, "")]

    link(block(fn.body, [("entry", "")], None), "exit")
    return out


def _names(s: ast.AST, kind: type) -> set[str]:
    """Names that a statement itself stores or loads, without those of statements inside it."""
    parts = [s]
    if isinstance(s, (ast.If, ast.While)):
        parts = [s.test]
    elif isinstance(s, (ast.For, ast.AsyncFor)):
        parts = [s.iter, s.target]
    elif isinstance(s, (ast.With, ast.AsyncWith)):
        parts = list(s.items)
    elif isinstance(s, (ast.Try, ast.Match, *_FUNCTION, ast.ClassDef)):
        parts = []
    found = {x.id for p in parts for x in ast.walk(p) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)}
    if kind is ast.Load and isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
        found.add(s.target.id)
    return found


def reaching_definitions(fn: ast.AST) -> list[tuple[object, object, str]]:
    """(definition, use, variable); a parameter is defined at 'entry'."""
    flow = control_flow(fn)
    before: dict[object, list] = defaultdict(list)
    after: dict[object, list] = defaultdict(list)
    for a, b, _ in flow:
        before[b].append(a)
        after[a].append(b)
    args = fn.args
    params = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
    places = list(dict.fromkeys([x for a, b, _ in flow for x in (a, b)]))
    gen = {s: {(v, s) for v in (params if s == "entry" else set() if s == "exit" else _names(s, ast.Store))} for s in places}
    out = {s: set(gen[s]) for s in places}
    work = list(places)
    while work:
        s = work.pop()
        names = {v for v, _ in gen[s]}
        into = set().union(*(out[p] for p in before[s])) if before[s] else set()
        new = gen[s] | {d for d in into if d[0] not in names}
        if new != out[s]:
            out[s] = new
            work += after[s]
    found = []
    for s in places:
        if s in ("entry", "exit"):
            continue
        into = set().union(*(out[p] for p in before[s])) if before[s] else set()
        used = _names(s, ast.Load)
        found += [(d, s, v) for v, d in into if v in used]
    return found


def derive(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges): nodes (id, kind, name, line_start, line_end, complexity), edges (src, dst, type, detail)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    nodes: list[tuple] = []
    edges: list[tuple] = []
    ids: dict[ast.AST, str] = {}
    root = node_id(path, "file", "", 0, 0)
    nodes.append((root, "file", path, 1, source.count("\n") + 1, None))

    def add(x: ast.AST, kind: str, name: str, parent: str, cost: int | None = None) -> str:
        i = node_id(path, kind, name, x.lineno, x.col_offset)
        ids[x] = i
        nodes.append((i, kind, name, x.lineno, x.end_lineno, cost))
        edges.append((parent, i, "PARENT_OF", ""))
        return i

    def visit(body: list[ast.stmt], parent: str, owner: ast.AST | None) -> None:
        for s in body:
            if isinstance(s, _FUNCTION):
                i = add(s, "function_definition", s.name, parent, complexity(s))
                edges.append((parent, i, "CONTAINS", ""))
                visit(s.body, i, s)
                flow(s, i)
            elif isinstance(s, ast.ClassDef):
                i = add(s, "class_definition", s.name, parent)
                edges.append((parent, i, "CONTAINS", ""))
                edges.extend((i, ast.unparse(b), "IMPLEMENTS", "name") for b in s.bases)
                visit(s.body, i, owner)
            else:
                i = add(s, type(s).__name__.lower(), "", parent)
                if isinstance(s, (ast.Import, ast.ImportFrom)):
                    module = s.module if isinstance(s, ast.ImportFrom) else s.names[0].name
                    edges.append((root, module or ".", "DEPENDS_ON", "name"))
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(s, part, []) or [], i, owner)
                for h in getattr(s, "handlers", []):
                    visit(h.body, i, owner)
                for c in getattr(s, "cases", []):
                    visit(c.body, i, owner)

    def flow(fn: ast.AST, i: str) -> None:
        def key(x: object) -> str:
            return x if not isinstance(x, str) else hashlib.sha256(f"{i}:{x}".encode()).hexdigest()[:32]

        for mark in ("entry", "exit"):
            nodes.append((key(mark), mark, "", fn.lineno, fn.end_lineno, None))
        place = lambda x: key(x) if isinstance(x, str) else ids[x]
        edges.extend((place(a), place(b), "FLOWS_TO", c) for a, b, c in control_flow(fn))
        edges.extend((place(a), place(b), "REACHES", v) for a, b, v in reaching_definitions(fn))
        inner = {x for f in ast.walk(fn) if isinstance(f, _FUNCTION) and f is not fn for x in ast.walk(f)}
        for call in ast.walk(fn):
            if isinstance(call, ast.Call) and call not in inner:
                f = call.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    edges.append((i, name, "CALLS", "attribute" if isinstance(f, ast.Attribute) else "name"))

    visit(tree.body, root, None)
    return nodes, edges


def python_graph(files: DataFrame, *, path_col: str = "file_path", code_col: str = "code") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all files; ends that are only known by name carry the name."""
    rows = files.select(F.col(path_col).alias("path"), F.col(code_col).alias("code")).where("path is not null and code is not null").distinct()

    def run(which: int, names: list[str], types: list[pa.DataType]):
        def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                out: list[tuple] = []
                for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out += [(path, *r) for r in derive(path, code)[which]]
                cols = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        return go

    s, i = pa.string(), pa.int32()
    nodes = rows.mapInArrow(run(0, NODE_NAMES, [s, s, s, s, i, i, i]), NODE_SCHEMA)
    edges = rows.mapInArrow(run(1, EDGE_NAMES, [s] * 5), EDGE_SCHEMA)
    return nodes, edges


def resolve_calls(nodes: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """(src, dst) of calls by name; never to itself.

    Plain names go to at most ``most`` definitions, or, if there are more, to at most ``most`` in
    the caller's file; attributes only to a unique definition.
    """
    defs = nodes.where("node_type = 'function_definition'").select(F.col("node_name").alias("callee"), F.col("id").alias("target"), "file_path")
    defs = defs.withColumn("n", F.count("*").over(Window.partitionBy("callee")))
    defs = defs.withColumn("here", F.count("*").over(Window.partitionBy("callee", "file_path"))).where(F.least("n", "here") <= most)
    # a common name is joined within its file only, so its calls and definitions aren't paired across files
    place = F.when(F.col("common"), F.col("file_path")).otherwise("")
    defs = defs.withColumn("common", F.col("n") > most).withColumn("place", place).drop("file_path")
    calls = edges.where("edge_type = 'CALLS'").select("src", F.col("dst").alias("callee"), "detail", "file_path").distinct()
    calls = calls.withColumn("common", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("place", place).drop("file_path")
    hits = calls.join(defs, ["callee", "common", "place"]).where(F.when(F.col("detail") == "attribute", F.col("n") == 1).otherwise(True))
    return hits.where("src <> target").select("src", F.col("target").alias("dst")).distinct()
