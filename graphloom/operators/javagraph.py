"""A code graph from Java sources: types, methods, statements, control flow, reaching definitions, typed calls.

A file is lexed and its declarations and statements are read by recursive descent;
expressions stay runs of tokens, from which definitions, uses and calls are taken.
The rows have the form of ``codegraph.derive``. Files whose brackets don't match
give no rows.

Break leads behind the innermost loop or switch or the labelled statement, continue
to its loop, return and throw to the exit; the cases of a switch fall through.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.codegraph import EDGE_NAMES, EDGE_SCHEMA, NODE_NAMES, NODE_SCHEMA, node_id
from graphloom.operators.traversal import transitive_closure

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?(?<!\\)\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'"
    r"|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|\.\.\.|&&|\|\||[-+*/%&|^!=<>]=|\+\+|--|\S"
)
_MODIFIERS = frozenset("public private protected static final abstract synchronized native transient volatile strictfp default sealed".split())
_TYPES = frozenset("class interface enum record".split())
_WORDS = frozenset(
    "if else for while do switch case default try catch finally return throw break continue new instanceof this super null true false int long short byte char "
    "boolean float double void assert synchronized yield var final static".split()
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(eq=False)
class Token:
    text: str
    line: int


@dataclass(eq=False)
class Statement:
    kind: str
    start: int
    end: int = 0  # behind the last token
    head: tuple[int, int] = (0, 0)  # the tokens of its own expressions
    body: list[Statement] = field(default_factory=list)
    other: list[list[Statement]] = field(default_factory=list)  # else, cases, handlers, finally
    label: str = ""


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[Token] = []
        line, at = 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if not m.group().startswith(("//", "/*")):
                self.tokens.append(Token(m.group(), line))
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.text in _OPEN:
                stack.append(k)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise SyntaxError("brackets don't match")
                self.match[stack.pop()] = k
        if stack:
            raise SyntaxError("brackets don't match")

    def at(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def skip_to(self, k: int, end: int, marks: str) -> int:
        """The place of the first of ``marks`` outside brackets."""
        while k < end and self.at(k) not in marks:
            k = self.match.get(k, k) + 1
        return k

    # -- statements -----------------------------------------------------------
    def block(self, k: int, end: int) -> list[Statement]:
        out = []
        while k < end:
            s = self.statement(k, end)
            out.append(s)
            k = max(s.end, k + 1)
        return out

    def inner(self, k: int, end: int) -> tuple[list[Statement], int]:
        """The statements of a body that may be a block, and the place behind it."""
        if self.at(k) == "{":
            return self.block(k + 1, self.match[k]), self.match[k] + 1
        s = self.statement(k, end)
        return [s], s.end

    def statement(self, k: int, end: int) -> Statement:
        word = self.at(k)
        s = Statement("expression", k, k + 1)
        if word == "{":
            s.kind, s.body, s.end = "block", self.block(k + 1, self.match[k]), self.match[k] + 1
        elif word == ";":
            s.kind = "empty"
        elif self.at(k + 1) == ":" and re.match(r"[A-Za-z_$]", word) and word not in _WORDS:
            s = self.statement(k + 2, end)
            s.label, s.start = word, k
        elif word in ("if", "while", "for", "switch", "synchronized") and self.at(k + 1) == "(":
            s.kind, s.head = word, (k + 2, self.match[k + 1])
            after = self.match[k + 1] + 1
            if word == "switch" and self.at(after) == "{":
                s.other, s.end = self.cases(after + 1, self.match[after]), self.match[after] + 1
            else:
                s.body, s.end = self.inner(after, end)
                if word == "if" and self.at(s.end) == "else":
                    other, s.end = self.inner(s.end + 1, end)
                    s.other.append(other)
        elif word == "do":
            s.kind = "do"
            s.body, after = self.inner(k + 1, end)
            s.head = (after + 2, self.match.get(after + 1, after + 2))
            s.end = self.skip_to(after, end, ";") + 1
        elif word == "try":
            s.kind, after = "try", k + 1
            if self.at(after) == "(":
                s.head, after = (after + 1, self.match[after]), self.match[after] + 1
            s.body, after = self.inner(after, end)
            while self.at(after) in ("catch", "finally"):
                start = after
                place = self.match[after + 1] + 1 if self.at(after) == "catch" else after + 1
                inner, after = self.inner(place, end)
                h = Statement(self.at(start), start, after, (start + 2, place - 1) if self.at(start) == "catch" else (start, start), inner)
                s.other.append([h])
            s.end = after
        elif word in _TYPES and re.match(r"[A-Za-z_$]", self.at(k + 1)) or word in ("abstract", "final") and self.at(k + 1) == "class":
            brace = self.skip_to(k, end, "{")
            s.kind, s.end = "type", self.match.get(brace, end - 1) + 1
        else:
            s.kind = word if word in ("return", "throw", "break", "continue", "assert", "yield") else "expression"
            s.end = self.skip_to(k, end, ";") + 1
            s.head = (k, s.end - 1)
            if s.kind == "expression" and self.declared(s) is not None:
                s.kind = "local"
        return s

    def cases(self, k: int, end: int) -> list[list[Statement]]:
        out: list[list[Statement]] = []
        while k < end:
            if self.at(k) in ("case", "default"):
                while k < end and self.at(k) not in (":", "->"):
                    k = self.match.get(k, k) + 1
                k += 1
                out.append([])
                continue
            s = self.statement(k, end)
            if not out:
                out.append([])
            out[-1].append(s)
            k = max(s.end, k + 1)
        return out

    # -- names in expressions -----------------------------------------------------
    def declared(self, s: Statement) -> tuple[str, str] | None:
        """(type, name) of a local variable."""
        k, end = s.head
        while self.at(k) == "final" or self.at(k) == "@":
            k += 2 if self.at(k) == "@" else 1
        place = self.type_end(k, end)
        if place is None or place >= end or not re.match(r"[A-Za-z_$]", self.at(place)) or self.at(place) in _WORDS:
            return None
        if self.at(place + 1) in ("=", ";", ",", ":", "[") or place + 1 >= end:
            return self.simple(k, place), self.at(place)
        return None

    def type_end(self, k: int, end: int) -> int | None:
        """Behind a type that begins at ``k``."""
        if not re.match(r"[A-Za-z_$]", self.at(k)) or self.at(k) in _WORDS - set("int long short byte char boolean float double void var".split()):
            return None
        k += 1
        while k < end:
            if self.at(k) == "." and re.match(r"[A-Za-z_$]", self.at(k + 1)):
                k += 2
            elif self.at(k) == "<":
                depth = 0
                while k < end:
                    depth += (self.at(k) == "<") - (self.at(k) == ">")
                    if self.at(k) in (";", "(", ")", "{", "=", "&&", "||"):
                        return None
                    k += 1
                    if not depth:
                        break
            elif self.at(k) == "[" and self.at(k + 1) == "]":
                k += 2
            elif self.at(k) == "...":
                k += 1
            else:
                break
        return k

    def simple(self, k: int, end: int) -> str:
        """The simple name of the type in a run of tokens."""
        name = ""
        while k < end and self.at(k) not in ("<", "[", "..."):
            if re.match(r"[A-Za-z_$]", self.at(k)):
                name = self.at(k)
            k += 1
        return name

    def writes(self, a: int, b: int) -> set[str]:
        out = set()
        for k in range(a, b):
            t = self.at(k)
            if re.match(r"[A-Za-z_$]", t) and t not in _WORDS and self.at(k - 1) != ".":
                if re.fullmatch(r"[-+*/%&|^]?=", self.at(k + 1)) or self.at(k + 1) in ("++", "--") or self.at(k - 1) in ("++", "--"):
                    out.add(t)
        return out

    def reads(self, a: int, b: int) -> set[str]:
        out = set()
        for k in range(a, b):
            t = self.at(k)
            if re.match(r"[A-Za-z_$]", t) and t not in _WORDS and self.at(k - 1) != "." and self.at(k + 1) != "(" and self.at(k + 1) != "=":
                out.add(t)
        return out

    def calls(self, a: int, b: int) -> Iterator[tuple[str, str, int]]:
        """(receiver, method, number of arguments) of the calls in a run of tokens."""
        for k in range(a, b - 1):
            if self.at(k + 1) == "(" and re.match(r"[A-Za-z_$]", self.at(k)) and self.at(k) not in _WORDS:
                if self.at(k - 1) == "new":
                    yield "new", self.at(k), self.count(k + 1)
                elif self.at(k - 1) == ".":
                    prev = self.at(k - 2)
                    if prev == ")":
                        opened = next((o for o, c in self.match.items() if c == k - 2), k)
                        prev = "new " + self.at(opened - 1) if self.at(opened - 2) == "new" else "()"
                    yield prev, self.at(k), self.count(k + 1)
                else:
                    yield "", self.at(k), self.count(k + 1)

    def count(self, k: int) -> int:
        end = self.match[k]
        if end == k + 1:
            return 0
        n, at = 1, k + 1
        while at < end:
            n += self.at(at) == ","
            at = self.match.get(at, at) + 1
        return n


def control_flow(body: list[Statement]) -> list[tuple[object, object, str]]:
    """(from, to, condition) between statements, 'entry' and 'exit'."""
    out: list[tuple[object, object, str]] = []

    def link(froms: list, to: object) -> None:
        out.extend((a, to, c) for a, c in froms)

    def block(stmts: list[Statement], froms: list, stack: list) -> list:
        for s in stmts:
            if s.kind in ("empty", "type"):
                continue
            if not froms:
                break
            if s.kind != "block":
                link(froms, s)
                froms = step(s, stack)
            else:
                froms = block(s.body, froms, stack)
        return froms

    def target(stack: list, label: str, loops: bool) -> dict | None:
        for frame in reversed(stack):
            if frame["label"] == label if label else (frame["loop"] or not loops):
                return frame
        return None

    def step(s: Statement, stack: list) -> list:
        if s.kind in ("return", "throw"):
            out.append((s, "exit", ""))
            return []
        if s.kind in ("break", "continue", "yield"):
            frame = target(stack, s.label, s.kind == "continue")
            if frame is not None:
                if s.kind == "continue":
                    out.append((s, frame["at"], "continue"))
                else:
                    frame["breaks"].append((s, "break"))
            return []
        if s.kind == "if":
            yes = block(s.body, [(s, "true")], stack)
            return yes + (block(s.other[0], [(s, "false")], stack) if s.other else [(s, "false")])
        if s.kind in ("while", "for", "do"):
            frame = {"at": s, "breaks": [], "loop": True, "label": s.label}
            link(block(s.body, [(s, "true")], [*stack, frame]), s)
            return [(s, "false"), *frame["breaks"]]
        if s.kind == "switch":
            frame = {"at": s, "breaks": [], "loop": False, "label": s.label}
            through: list = []
            for case in s.other:
                through = block(case, [(s, "case"), *through], [*stack, frame])
            return [*through, (s, "no case"), *frame["breaks"]]
        if s.kind == "try":
            done = block(s.body, [(s, "")], stack)
            last: list[Statement] = []
            for (h,) in s.other:
                if h.kind == "finally":
                    last = h.body
                else:
                    link([(s, "exception")], h)
                    done += block(h.body, [(h, "")], stack)
            return block(last, done, stack) if last else done
        if s.kind == "synchronized":
            return block(s.body, [(s, "")], stack)
        return [(s, "")]

    link(block(body, [("entry", "")], []), "exit")
    return out


def reaching(flow: list[tuple], gen: dict[object, set[str]], use: dict[object, set[str]]) -> list[tuple[object, object, str]]:
    """(definition, use, variable) along a flow."""
    before: dict[object, list] = defaultdict(list)
    after: dict[object, list] = defaultdict(list)
    for a, b, _ in flow:
        before[b].append(a)
        after[a].append(b)
    places = list(dict.fromkeys(x for a, b, _ in flow for x in (a, b)))
    out = {s: {(v, s) for v in gen.get(s, ())} for s in places}

    def into(s: object) -> set:
        return set().union(*(out[p] for p in before[s])) if before[s] else set()

    work = list(places)
    while work:
        s = work.pop()
        own = gen.get(s, set())
        new = {(v, s) for v in own} | {d for d in into(s) if d[0] not in own}
        if new != out[s]:
            out[s] = new
            work += after[s]
    return [(d, s, v) for s in places for v, d in into(s) if v in use.get(s, ())]


def derive(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) as ``codegraph.derive`` gives them; calls carry the receiver's type and the number of arguments."""
    try:
        p = Parser(source)
    except SyntaxError:
        return [], []
    nodes: list[tuple] = []
    edges: list[tuple] = []
    root = node_id(path, "file", "", 0, 0)
    nodes.append((root, "file", path, 1, source.count("\n") + 1, None))

    def add(kind: str, name: str, a: int, b: int, parent: str, cost: int | None = None) -> str:
        i = node_id(path, kind, name, p.tokens[a].line, a)
        nodes.append((i, kind, name, p.tokens[a].line, p.tokens[max(a, min(b, len(p.tokens)) - 1)].line, cost))
        edges.append((parent, i, "PARENT_OF", ""))
        return i

    def members(k: int, end: int, parent: str, owner: str) -> None:
        fields: dict[str, str] = {}
        methods: list[tuple] = []
        while k < end:
            start = k
            while k < end and (p.at(k) in _MODIFIERS or p.at(k) == "@" and p.at(k + 1) != "interface"):
                if p.at(k) == "@":
                    k += 2
                    while p.at(k) == ".":
                        k += 2
                    k = p.match[k] + 1 if p.at(k) == "(" else k
                else:
                    k += 1
            if p.at(k) == "@":
                k += 1
            if p.at(k) == "import" or p.at(k) == "package":
                stop = p.skip_to(k, end, ";")
                if p.at(k) == "import":
                    edges.append((root, "".join(p.at(j) for j in range(k + 1, stop) if p.at(j) != "static"), "DEPENDS_ON", "name"))
                k = stop + 1
                continue
            if p.at(k) in _TYPES and re.match(r"[A-Za-z_$]", p.at(k + 1)):
                brace = p.skip_to(k + 1, end, "{")
                i = add("class_definition", p.at(k + 1), start, p.match.get(brace, end) + 1, parent)
                edges.append((parent, i, "CONTAINS", ""))
                for j in range(k + 2, brace):
                    if p.at(j) in ("extends", "implements", ","):
                        stop = p.type_end(j + 1, brace)
                        if stop and p.at(j - 1) not in ("<", "?") and not _in_angle(p, k + 2, j):
                            edges.append((i, p.simple(j + 1, stop), "IMPLEMENTS", "name"))
                body = brace + 1
                if p.at(k) == "enum":
                    body = p.skip_to(body, p.match.get(brace, end), ";") + 1
                if brace in p.match:
                    members(body, p.match[brace], i, p.at(k + 1))
                    k = p.match[brace] + 1
                else:
                    k = brace + 1
                continue
            if p.at(k) == "{":  # an initialiser
                methods.append(("<init>", k, k, [], (k + 1, p.match[k])))
                k = p.match[k] + 1
                continue
            if p.at(k) == "<":
                depth = 0
                while k < end:
                    depth += (p.at(k) == "<") - (p.at(k) == ">")
                    k += 1
                    if not depth:
                        break
            place = k if p.at(k + 1) == "(" else p.type_end(k, end)
            if place is not None and p.at(place + 1) == "(" and re.match(r"[A-Za-z_$]", p.at(place)):
                params = []
                at, close = place + 2, p.match[place + 1]
                while at < close:
                    stop = p.skip_to(at, close, ",")
                    if stop > at:
                        params.append((p.simple(at + (p.at(at) == "final"), stop - 1), p.at(stop - 1)))
                    at = stop + 1
                k = p.skip_to(close + 1, end, "{;")
                span = (k + 1, p.match[k]) if p.at(k) == "{" else (k, k)
                methods.append((p.at(place), start, span[1] + 1, params, span))
                k = span[1] + 1
                continue
            stop = p.skip_to(k, end, ";")
            found = p.declared(Statement("field", k, stop, (k, stop)))
            if found:
                fields[found[1]] = found[0]
            k = stop + 1 if stop < end else end
        for name, a, b, params, (x, y) in methods:
            method(name, a, b, params, p.block(x, y) if y > x else [], (x, y), parent, owner, fields)

    def method(name: str, a: int, b: int, params: list, body: list[Statement], span: tuple[int, int], parent: str, owner: str, fields: dict) -> None:
        words = [p.at(k) for k in range(*span)]
        cost = 1 + sum(w in ("if", "for", "while", "case", "catch", "&&", "||", "?", "do", "assert") for w in words)
        i = add("method_declaration", name, a, b, parent, cost)
        edges.append((parent, i, "CONTAINS", ""))
        types = {**fields, **{n: t for t, n in params}}
        gen: dict[object, set[str]] = {"entry": {n for _, n in params}}
        use: dict[object, set[str]] = {}
        ids: dict[object, str] = {}

        def walk(stmts: list[Statement], above: str) -> None:
            for s in stmts:
                here = add(s.kind, "", s.start, s.end, above)
                ids[s] = here
                gen[s], use[s] = p.writes(*s.head), p.reads(*s.head)
                for local in (p.declared(s), p.declared(Statement("", 0, 0, (s.head[0], p.skip_to(*s.head, ";")))) if s.kind in ("for", "try", "catch") else None):
                    if local:
                        types[local[1]] = local[0]
                        gen[s].add(local[1])
                        use[s] -= {local[1]} if s.kind == "local" else set()
                if s.kind in ("break", "continue") and s.head[1] - s.head[0] > 1:
                    s.label = p.at(s.head[0] + 1)
                walk(s.body, here)
                for part in s.other:
                    walk(part, here)

        walk(body, i)
        marks = {m: hashlib.sha256(f"{i}:{m}".encode()).hexdigest()[:32] for m in ("entry", "exit")}
        for m, key in marks.items():
            nodes.append((key, m, "", p.tokens[a].line, p.tokens[min(b, len(p.tokens)) - 1].line, None))
        flow = control_flow(body)
        place = lambda x: marks[x] if isinstance(x, str) else ids[x]
        edges.extend((place(x), place(y), "FLOWS_TO", c) for x, y, c in flow)
        edges.extend((place(x), place(y), "REACHES", v) for x, y, v in reaching(flow, gen, use))
        for receiver, called, n in p.calls(*span):
            if receiver in ("", "this"):
                kind = owner
            elif receiver == "new":
                kind, called = called, called
            elif receiver.startswith("new "):
                kind = receiver[4:]
            else:
                kind = types.get(receiver, receiver if receiver[:1].isupper() else "")
            edges.append((i, called, "CALLS", f"{kind}/{n}"))

    members(0, len(p.tokens), root, "")
    return nodes, edges


def _in_angle(p: Parser, a: int, b: int) -> bool:
    return sum((p.at(k) == "<") - (p.at(k) == ">") for k in range(a, b)) > 0


def java_graph(files: DataFrame, *, path_col: str = "file_path", code_col: str = "code") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all Java files; ends that are only known by name carry the name."""
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
    return rows.mapInArrow(run(0, NODE_NAMES, [s, s, s, s, i, i, i]), NODE_SCHEMA), rows.mapInArrow(run(1, EDGE_NAMES, [s] * 5), EDGE_SCHEMA)


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, resolution) of the calls: typed where the receiver's class, or one above it, has the method; else heuristic, where one method alone has the name.

    Of several classes above, the methods of the nearest known ones all count; classes are known by simple name.
    """
    classes = nodes.where("node_type = 'class_definition'").select(F.col("id").alias("class_id"), F.col("node_name").alias("class"))
    methods = nodes.where("node_type = 'method_declaration'").select(F.col("id").alias("method_id"), F.col("node_name").alias("called"))
    held = edges.where("edge_type = 'CONTAINS'").select(F.col("src").alias("class_id"), F.col("dst").alias("method_id"))
    table = classes.join(held, "class_id").join(methods, "method_id").select("class", "called", "method_id").distinct()
    named = edges.where("edge_type = 'IMPLEMENTS'").select(F.col("src").alias("class_id"), F.col("dst").alias("above"))
    direct = classes.join(named, "class_id").select(F.col("class").alias("src"), F.col("above").alias("dst")).where("src <> dst").distinct()
    above = transitive_closure(direct).select(F.col("src").alias("class"), F.col("dst").alias("up"))
    parts = F.split("detail", "/")
    calls = edges.where("edge_type = 'CALLS'").select("src", F.col("dst").alias("called"), parts[0].alias("class")).distinct()
    own = calls.join(table, ["class", "called"])
    rest = calls.join(own.select("src", "called", "class").distinct(), ["src", "called", "class"], "left_anti")
    up = rest.join(above, "class").join(table.withColumnRenamed("class", "up"), ["up", "called"])
    typed = own.select("src", "called", "class", F.col("method_id").alias("dst")).unionByName(up.select("src", "called", "class", F.col("method_id").alias("dst")))
    left = rest.join(up.select("src", "called", "class").distinct(), ["src", "called", "class"], "left_anti")
    unique = table.groupBy("called").agg(F.count_distinct("method_id").alias("n"), F.min("method_id").alias("dst")).where("n = 1")
    guessed = left.join(unique, "called").select("src", "dst", F.lit("heuristic").alias("resolution"))
    out = typed.select("src", "dst", F.lit("typed").alias("resolution")).unionByName(guessed).where("src <> dst")
    return out.groupBy("src", "dst").agg(F.max("resolution").alias("resolution"))
