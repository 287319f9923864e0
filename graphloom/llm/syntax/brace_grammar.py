"""The local grammars of Java and JavaScript: statements between braces and semicolons.

A skeleton is cut at braces and semicolons. What stands before a brace decides
what the brace opens: a block, a class body, an object, an array. A block that
belongs to an expression is replaced by a mark once it is closed, so that the
statement around it can be parsed as a whole. Statements repeat in their
skeletons, so each different one is parsed once.
"""

from __future__ import annotations

import re

_CUT = re.compile(r"([{};])")
_TOKEN = re.compile(
    r"\n|[\w$]+|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--"
    r"|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[^\s]"
)
_RUN = re.compile(r"(?<![\w:])(?<!: )(?:[0S]\s*,\s*)+(?=[0S]\b\s*[,)\]}]|[0S]\s*$)")
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())


class Bad(Exception):
    """The tokens aren't a phrase of the grammar."""


class Cursor:
    """Tokens with a place; ``line`` tells which tokens begin a line."""

    def __init__(self, text: str) -> None:
        self.toks: list[str] = []
        self.line: list[bool] = []
        fresh = False
        for t in _TOKEN.findall(text):
            if t == "\n":
                fresh = True
            else:
                self.toks.append(t)
                self.line.append(fresh)
                fresh = False
        self.i = 0

    def peek(self, k: int = 0) -> str:
        j = self.i + k
        return self.toks[j] if j < len(self.toks) else ""

    def next(self) -> str:
        t = self.peek()
        if not t:
            raise Bad
        self.i += 1
        return t

    def accept(self, *options: str) -> str:
        t = self.peek()
        if t and t in options:
            self.i += 1
            return t
        return ""

    def expect(self, *options: str) -> str:
        t = self.accept(*options)
        if not t:
            raise Bad
        return t

    def done(self) -> bool:
        return self.i >= len(self.toks)

    def new_line(self) -> bool:
        return self.i < len(self.line) and self.line[self.i]

    def closing(self) -> int:
        """The place of the bracket that closes the one here, or -1."""
        depth = 0
        for j in range(self.i, len(self.toks)):
            if self.toks[j] in "([":
                depth += 1
            elif self.toks[j] in ")]":
                depth -= 1
                if depth == 0:
                    return j
        return -1


class Java:
    """Phrases of Java. B stands for a block that was closed before."""

    PRIMITIVE = frozenset("boolean byte char double float int long short void".split())
    MODIFIER = frozenset(
        "public protected private static final abstract native synchronized transient volatile strictfp default".split()
    )
    BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())

    def __init__(self, text: str) -> None:
        self.c = c = Cursor(text)
        toks = c.toks
        for k, t in enumerate(toks):
            if t == "record" and not (
                toks[k + 1 : k + 2] == ["n"] and toks[k + 2 : k + 3] in (["("], ["<"]) and (not k or toks[k - 1] != ".")
            ):
                toks[k] = "n"  # the word is a name elsewhere

    # types
    def annotations(self) -> None:
        c = self.c
        while c.peek() == "@" and c.peek(1) != "interface":
            c.next()
            self.name()
            if c.accept("("):
                if not c.accept(")"):
                    while True:
                        self.expr()
                        if not c.accept(","):
                            break
                    c.expect(")")

    def name(self) -> None:
        self.c.expect("n")
        while self.c.peek() == "." and self.c.peek(1) == "n":
            self.c.i += 2

    def dims(self) -> None:
        while self.c.peek() == "[" and self.c.peek(1) == "]":
            self.c.i += 2

    def type_args(self) -> None:
        c = self.c
        c.expect("<")
        if not c.accept(">"):
            while True:
                self.annotations()
                if c.accept("?"):
                    if c.accept("extends", "super"):
                        self.type()
                else:
                    self.type()
                    if c.accept("extends"):
                        self.type()
                while c.accept("&"):
                    self.type()
                if not c.accept(","):
                    break
            c.expect(">")

    def type(self) -> None:
        c = self.c
        self.annotations()
        if c.peek() in self.PRIMITIVE:
            c.next()
        else:
            c.expect("n")
            if c.peek() == "<":
                self.type_args()
            while c.peek() == "." and c.peek(1) == "n":
                c.i += 2
                if c.peek() == "<":
                    self.type_args()
        self.dims()

    def types(self) -> None:
        self.type()
        while self.c.accept(",", "&"):
            self.type()

    def modifiers(self) -> None:
        c = self.c
        while True:
            if c.peek() in self.MODIFIER:
                c.next()
            elif c.peek() == "n" and c.peek(1) == "-" and c.peek(2) == "n" and c.peek(3) in ("class", "interface"):
                c.i += 3
            elif c.peek() == "n" and c.peek(1) in ("class", "interface", *self.MODIFIER):
                c.next()  # sealed
            elif c.peek() == "@" and c.peek(1) != "interface":
                self.annotations()
            else:
                return

    def params(self) -> None:
        c = self.c
        c.expect("(")
        if c.accept(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            c.accept("...")
            c.expect("n", "this")
            self.dims()
            if not c.accept(","):
                break
        c.expect(")")

    # expressions; each returns what kind of expression it was
    def args(self) -> None:
        c = self.c
        c.expect("(")
        if c.accept(")"):
            return
        while True:
            self.expr()
            if not c.accept(","):
                break
        c.expect(")")

    def lambda_params(self) -> bool:
        c = self.c
        if c.peek() == "n" and c.peek(1) == "->":
            c.i += 2
            return True
        if c.peek() == "(":
            j = c.closing()
            if j > 0 and j + 1 < len(c.toks) and c.toks[j + 1] == "->":
                start = c.i
                try:
                    self.params()
                except Bad:
                    c.i = start + 1
                    while True:
                        c.expect("n")
                        if not c.accept(","):
                            break
                    c.expect(")")
                c.expect("->")
                return True
        return False

    def expr(self) -> str:
        c = self.c
        if self.lambda_params():
            if not c.accept("B"):
                self.expr()
            return "other"
        kind = self.operand()
        while True:
            t = c.peek()
            if t == ">":
                c.next()
                while c.peek() in (">", ">="):
                    c.next()
                c.accept("=")
                self.rhs()
                kind = "binary"
            elif t in _ASSIGN:
                if kind == "binary":
                    raise Bad
                c.next()
                self.expr()
                return "assign"
            elif t in self.BINARY and t:
                c.next()
                self.rhs()
                kind = "binary"
            elif t == "?":
                c.next()
                self.expr()
                c.expect(":")
                self.expr()
                return "other"
            elif t == "instanceof":
                c.next()
                c.accept("final")
                self.type()
                if c.peek() == "(":
                    self.params()
                c.accept("n")
                kind = "binary"
            else:
                return kind

    def rhs(self) -> None:
        if self.lambda_params():
            if not self.c.accept("B"):
                self.expr()
        else:
            self.operand()

    def cast(self) -> bool:
        """Whether a cast stands here; it is passed over."""
        c = self.c
        start = c.i
        c.expect("(")
        try:
            primitive = c.peek() in self.PRIMITIVE
            self.types()
            c.expect(")")
        except Bad:
            c.i = start
            return False
        t = c.peek()
        if t in ("n", "0", "S", "(", "!", "~", "this", "new", "super", "true", "false", "null", "switch") or (
            primitive and t in ("+", "-", "++", "--", *self.PRIMITIVE)
        ):
            return True
        c.i = start
        return False

    def operand(self) -> str:
        c = self.c
        t = c.peek()
        if t in ("++", "--"):
            c.next()
            self.operand()
            return "incdec"
        if t in ("+", "-", "!", "~"):
            c.next()
            self.operand()
            return "other"
        if t == "(":
            if self.cast():
                if self.lambda_params():
                    if not c.accept("B"):
                        self.expr()
                else:
                    self.operand()
                return "other"
            c.next()
            self.expr()
            c.expect(")")
            kind = "other"
        elif t == "new":
            kind = self.creator()
        elif t == "switch":
            c.next()
            c.expect("(")
            self.expr()
            c.expect(")")
            c.expect("B")
            kind = "other"
        elif t in self.PRIMITIVE:
            c.next()
            self.dims()
            if c.accept("::"):
                c.expect("new")
            else:
                c.expect(".")
                c.expect("class")
            kind = "other"
        elif t in ("n", "0", "S", "this", "super", "true", "false", "null", "B", "yield"):
            c.next()
            kind = "other"
        else:
            raise Bad
        return self.postfix(kind)

    def creator(self) -> str:
        c = self.c
        c.expect("new")
        self.annotations()
        if c.peek() in self.PRIMITIVE:
            c.next()
        else:
            if c.peek() == "<":
                self.type_args()
            c.expect("n")
            if c.peek() == "<":
                self.type_args()
            while c.peek() == "." and c.peek(1) == "n":
                c.i += 2
                if c.peek() == "<":
                    self.type_args()
        if c.peek() == "[":
            while c.accept("["):
                if c.peek() != "]":
                    self.expr()
                c.expect("]")
            c.accept("B")
            return "other"
        self.args()
        c.accept("B")
        return "new"

    def postfix(self, kind: str) -> str:
        c = self.c
        while True:
            t = c.peek()
            if t == ".":
                c.next()
                if c.peek() == "<":
                    self.type_args()
                if c.peek() == "new":
                    kind = self.creator()
                else:
                    c.expect("n", "this", "super", "class", "yield")
                    kind = "other"
            elif t == "(":
                self.args()
                kind = "call"
            elif t == "[":
                c.next()
                if c.accept("]"):
                    self.dims()
                    if c.accept("::"):
                        c.expect("new")
                    else:
                        c.expect(".")
                        c.expect("class")
                else:
                    self.expr()
                    c.expect("]")
                kind = "other"
            elif t in ("++", "--"):
                c.next()
                kind = "incdec"
            elif t == "::":
                c.next()
                if c.peek() == "<":
                    self.type_args()
                c.expect("n", "new")
                kind = "other"
            elif t == "<":
                start = c.i
                try:
                    self.type_args()
                    self.dims()
                    while c.accept("."):
                        c.expect("n")
                    if c.peek() != "::":
                        raise Bad
                except Bad:
                    c.i = start
                    return kind
            else:
                return kind

    # statements
    def declaration(self) -> bool:
        """Whether a local variable or a field is declared here; it is passed over."""
        c = self.c
        start = c.i
        try:
            self.modifiers()
            self.type()
            c.expect("n")
            if c.peek() not in ("", "=", ",", "[", ":"):
                raise Bad
        except Bad:
            c.i = start
            return False
        while True:
            self.dims()
            if c.accept("="):
                self.expr()
            if not c.accept(","):
                return True
            c.expect("n")

    def statement(self) -> str:
        """The kind of the statement that all tokens from here make."""
        c = self.c
        if c.done():
            return "empty"
        t = c.peek()
        if t in ("case", "default") and c.peek(1) != "(":
            self.label()
            if c.toks[c.i - 1] == "->" and c.peek() not in ("throw", ""):
                self.expr()  # the value of a rule
                self.finish()
                return "other"
            inner = self.statement()
            return "other" if inner == "empty" else inner
        if t == "n" and c.peek(1) == ":" and c.peek(2) != ":":
            c.i += 2
            return self.statement()
        if t == "if":
            c.next()
            self.condition()
            self.statement()
            return "if"
        if t == "else":
            c.next()
            inner = self.statement()
            return "elif" if inner == "if" else "other"
        if t in ("while", "for", "synchronized"):
            self.loop_head()
            self.statement()
            return "other"
        if t == "do":
            c.next()
            raise Bad
        if t == "return":
            c.next()
            if not c.done():
                self.expr()
        elif t in ("throw", "yield") and c.peek(1) not in _ASSIGN | {".", "++", "--"}:
            c.next()
            self.expr()
        elif t in ("break", "continue"):
            c.next()
            c.accept("n")
        elif t == "assert":
            c.next()
            self.expr()
            if c.accept(":"):
                self.expr()
        elif not self.declaration():
            if self.expr() in ("other", "binary") or not c.done():
                raise Bad
        if not c.done():
            raise Bad
        return "other"

    def label(self) -> None:
        """A case or default of a switch, up to its colon or arrow."""
        c = self.c
        plain = c.next() == "default"
        start = c.i
        depth = 0
        while True:
            t = c.next()
            if t in "([":
                depth += 1
            elif t in ")]":
                depth -= 1
            elif t in (":", "->") and depth == 0:
                break
        if plain != (c.i - start == 1):
            raise Bad

    def condition(self) -> None:
        self.c.expect("(")
        self.expr()
        self.c.expect(")")

    def loop_head(self) -> None:
        c = self.c
        word = c.next()
        if word != "for":
            self.condition()
            return
        c.expect("(")
        j = c.i
        if c.peek() != ";":
            if not self.declaration():
                self.expr_list()
        if c.accept(":"):
            if c.toks[j] in ("for",):
                raise Bad
            self.expr()
        else:
            c.expect(";")
            if c.peek() != ";":
                self.expr()
            c.expect(";")
            if c.peek() != ")":
                self.expr_list()
        c.expect(")")

    def expr_list(self) -> None:
        self.expr()
        while self.c.accept(","):
            self.expr()

    def type_head(self) -> str:
        """The head of a class, interface, enum or record: the context of its body, or ''."""
        c = self.c
        start = c.i
        try:
            self.modifiers()
            if c.accept("@"):
                c.expect("interface")
                word = "interface"
            else:
                word = c.expect("class", "interface", "enum", "record")
            c.expect("n")
            if c.peek() == "<":
                self.type_args()
            if word == "record":
                self.params()
            if c.accept("extends"):
                self.types()
            if c.accept("implements"):
                self.types()
            if c.accept("n"):  # permits
                self.types()
            if c.done():
                return "enum" if word == "enum" else "class"
        except Bad:
            pass
        c.i = start
        return ""

    def method_head(self) -> None:
        c = self.c
        self.modifiers()
        if c.peek() == "<":
            self.type_args()
            self.annotations()
        if not (c.peek() == "n" and c.peek(1) in ("(", "")):
            self.type()
        c.expect("n")
        if c.done():
            return
        self.params()
        self.dims()
        if c.accept("throws"):
            self.types()

    def block_head(self) -> str:
        """The kind of the statement whose block follows, where it is a statement's."""
        c = self.c
        if c.done():
            return "other"
        t = c.peek()
        if t in ("case", "default"):
            self.label()
            return self.block_head()
        if t == "n" and c.peek(1) == ":":
            c.i += 2
            return self.block_head()
        if t == "else":
            c.next()
            inner = self.block_head()
            return "elif" if inner == "if" else "other"
        if t == "if":
            c.next()
            self.condition()
            inner = self.block_head()
            return "if" if inner in ("other", "if") else inner
        if t in ("while", "for", "synchronized"):
            self.loop_head()
            return self.block_head() if not c.done() else "other"
        if t == "do":
            c.next()
            self.finish()
            return "do"
        if t == "finally":
            c.next()
            self.finish()
            return "finally"
        if t == "try":
            c.next()
            if c.done():
                return "try"
            c.expect("(")
            while c.peek() != ")":
                if not self.declaration():
                    self.expr()
                if not c.accept(";"):
                    break
            c.expect(")")
            self.finish()
            return "tryr"
        if t == "catch":
            c.next()
            c.expect("(")
            self.modifiers()
            self.type()
            while c.accept("|"):
                self.type()
            c.expect("n")
            c.expect(")")
            self.finish()
            return "catch"
        if t == "switch":
            c.next()
            self.condition()
            self.finish()
            return "switch"
        raise Bad

    def finish(self) -> None:
        if not self.c.done():
            raise Bad

    # the three questions that the driver asks
    @classmethod
    def opens(cls, ctx: str, text: str) -> tuple[str, str, str]:
        """(context, kind, mode) of the brace after ``text``; mode is stmt or expr."""
        if ctx == "array":
            if text in ("", ",") or text.endswith(","):
                return "array", "other", "expr"
        elif ctx in ("file", "class", "enum"):
            p = cls(text)
            inner = p.type_head()
            if inner:
                return inner, "other", "stmt"
            if ctx != "file":
                if ctx == "class" and text in ("", "static"):
                    return "block", "other", "stmt"
                p = cls(text)
                try:
                    p.method_head()
                    if p.c.done() and text:
                        return "block", "other", "stmt"
                except Bad:
                    pass
        else:
            p = cls(text)
            inner = p.type_head()
            if inner:
                return inner, "other", "stmt"
            p = cls(text)
            try:
                kind = p.block_head()
                return ("switch" if kind == "switch" else "block"), ("other" if kind == "switch" else kind), "stmt"
            except Bad:
                pass
        toks = Cursor(text).toks
        if toks and toks[-1] == "->":
            return "block", "other", "expr"
        if not toks or toks[-1] in ("=", ",", "(", "]"):
            if ctx in ("file",) and "@" not in toks:
                raise Bad
            return "array", "other", "expr"
        if toks[-1] == ")":
            depth = 0
            for j in range(len(toks) - 1, -1, -1):
                if toks[j] == ")":
                    depth += 1
                elif toks[j] == "(":
                    depth -= 1
                    if depth == 0:
                        break
            if j and toks[j - 1] == "switch":
                return "switch", "other", "expr"
            k = j - 1
            while k >= 0 and toks[k] in ("n", ".", "<", ">", ",", "?", "[", "]", "extends", "super"):
                k -= 1
            if k >= 0 and toks[k] == "new":
                return "class", "other", "expr"
            if ctx == "enum":
                return "class", "other", "expr"
        elif ctx == "enum" and toks[-1] == "n":
            return "class", "other", "expr"
        raise Bad

    @classmethod
    def ends(cls, ctx: str, text: str) -> str:
        """The kind of the statement that ends with a semicolon."""
        p = cls(text)
        if ctx == "array":
            raise Bad
        if ctx == "file":
            if not text:
                return "other"
            p.annotations()
            if p.c.accept("n"):  # package is no keyword of the lexer's
                p.name()
                p.finish()
            elif p.c.accept("package"):
                p.name()
                p.finish()
            else:
                p.c.expect("import")
                p.c.accept("static")
                p.name()
                if p.c.accept("."):
                    p.c.expect("*")
                p.finish()
            return "other"
        if ctx == "enum":
            cls.enum_constants(text)
            return "enum"
        if ctx == "class":
            if not text:
                return "other"
            if p.declaration() and p.c.done():
                return "other"
            p.c.i = 0
            p.method_head()
            if p.c.accept("default"):
                p.expr()
            p.finish()
            if "(" not in text:
                raise Bad
            return "other"
        return p.statement()

    @classmethod
    def closes(cls, ctx: str, text: str) -> None:
        """What stands before a closing brace."""
        if ctx == "array":
            p = cls(text)
            while not p.c.done():
                p.expr()
                if not p.c.accept(","):
                    p.finish()
        elif ctx == "enum":
            cls.enum_constants(text)
        elif ctx in ("switch", "block") and text:
            p = cls(text)
            while p.c.peek() in ("case", "default"):
                p.label()
            p.finish()
            if ctx == "block":
                raise Bad
        elif text:
            raise Bad

    @classmethod
    def enum_constants(cls, text: str) -> None:
        p = cls(text)
        while not p.c.done():
            p.annotations()
            p.c.expect("n")
            if p.c.peek() == "(":
                p.args()
            p.c.accept("B")
            if not p.c.accept(","):
                p.finish()

    @classmethod
    def at_end(cls, text: str) -> None:
        if text:
            raise Bad


class JavaScript:
    """Phrases of JavaScript. B stands for a block, object or class that was closed before, T for a template."""

    BINARY = (
        frozenset(
            "|| && ?? | ^ & == != === !== < > <= >= instanceof in << + - * / % **".split()
        )
        | _ASSIGN
    )
    PREFIX = frozenset("+ - ! ~ ++ -- typeof void delete await ...".split())
    WORDS = re.compile(r"[A-Za-z_$][\w$]*")
    #: keywords that may also be names
    SOFT = frozenset("async await get of set static yield let".split())

    def __init__(self, text: str) -> None:
        self.c = Cursor(text)

    def is_name(self, t: str) -> bool:
        return t == "n" or t in self.SOFT

    def finish(self) -> None:
        if not self.c.done():
            raise Bad

    # expressions
    def expression(self) -> None:
        self.expr()
        while self.c.accept(","):
            self.expr()

    def arrow(self) -> bool:
        c = self.c
        start = c.i
        if c.peek() == "async" and (self.is_name(c.peek(1)) or c.peek(1) == "("):
            c.next()
        if self.is_name(c.peek()) and c.peek(1) == "=>":
            c.i += 2
        elif c.peek() == "(":
            j = c.closing()
            if j < 0 or j + 1 >= len(c.toks) or c.toks[j + 1] != "=>":
                c.i = start
                return False
            self.params()
            c.expect("=>")
        else:
            c.i = start
            return False
        if not c.accept("B"):
            self.expr()
        return True

    def params(self) -> None:
        c = self.c
        c.expect("(")
        while c.peek() != ")":
            c.accept("...")
            self.binding()
            if not c.accept(","):
                break
        c.expect(")")

    def binding(self) -> None:
        self.pattern()
        if self.c.accept("="):
            self.expr()

    def pattern(self) -> None:
        c = self.c
        if c.peek() == "[":
            self.array()
        elif not c.accept("B"):
            if not self.is_name(c.next()):
                raise Bad

    def array(self) -> None:
        c = self.c
        c.expect("[")
        while c.peek() != "]":
            if c.accept(","):
                continue
            self.expr()
            if c.peek() != "]":
                c.expect(",")
        c.expect("]")

    def expr(self, no_in: bool = False) -> None:
        c = self.c
        if self.arrow():
            return
        if c.peek() == "yield" and c.peek(1) not in _ASSIGN:
            c.next()
            c.accept("*")
            if c.done() or c.peek() in (")", "]", ",", ":") or c.new_line():
                return
            self.expr(no_in)
            return
        self.operand()
        while True:
            t = c.peek()
            if t == ">":
                c.next()
                while c.peek() in (">", ">="):
                    c.next()
                c.accept("=")
                if not self.arrow():
                    self.operand()
            elif t and t in self.BINARY and not (no_in and t == "in"):
                c.next()
                if t in _ASSIGN:
                    self.expr(no_in)
                    return
                if not self.arrow():
                    self.operand()
            elif t == "?":
                c.next()
                self.expr()
                c.expect(":")
                self.expr(no_in)
                return
            else:
                return

    def operand(self) -> None:
        c = self.c
        t = c.peek()
        if t in self.PREFIX and not (t == "await" and c.peek(1) in ("", ",", ")", "=", ".")):
            c.next()
            self.operand()
            return
        if t == "(":
            c.next()
            self.expression()
            c.expect(")")
        elif t == "[":
            self.array()
        elif t == "new":
            c.next()
            if c.accept("."):
                c.expect("n")
            else:
                self.new_target()
                if c.peek() == "(":
                    self.args()
        elif t == "function" or t == "async" and c.peek(1) == "function":
            c.accept("async")
            c.next()
            c.accept("*")
            if self.is_name(c.peek()):
                c.next()
            self.params()
            c.expect("B")
        elif t == "class":
            c.next()
            if self.is_name(c.peek()):
                c.next()
            if c.accept("extends"):
                self.operand_lhs()
            c.expect("B")
        elif t == "import":
            c.next()
            if c.accept("."):
                c.expect("n")
            elif c.peek() != "(":
                raise Bad
        elif t in ("0", "S", "T", "B", "this", "super", "null", "true", "false") or self.is_name(t):
            c.next()
        else:
            raise Bad
        self.postfix()

    def new_target(self) -> None:
        c = self.c
        if c.peek() == "(":
            c.next()
            self.expression()
            c.expect(")")
        elif c.peek() in ("new", "class", "function"):
            start = c.i
            t = c.peek()
            if t == "new":
                c.next()
                self.new_target()
                if c.peek() == "(":
                    self.args()
            else:
                c.i = start
                self.operand()
                return
        elif not (c.accept("this", "super") or self.is_name(c.peek()) and c.next()):
            raise Bad
        while True:
            if c.accept("."):
                self.member()
            elif c.peek() == "[":
                c.next()
                self.expression()
                c.expect("]")
            else:
                return

    def operand_lhs(self) -> None:
        c = self.c
        if c.peek() == "(":
            c.next()
            self.expression()
            c.expect(")")
        elif not (self.is_name(c.peek()) and c.next()) and not c.accept("null", "this"):
            raise Bad
        while True:
            if c.accept("."):
                self.member()
            elif c.peek() == "(":
                self.args()
            elif c.peek() == "[":
                c.next()
                self.expression()
                c.expect("]")
            else:
                return

    def member(self) -> None:
        self.c.accept("#")
        if not self.WORDS.fullmatch(self.c.next()):
            raise Bad

    def args(self) -> None:
        c = self.c
        c.expect("(")
        while c.peek() != ")":
            self.expr()
            if not c.accept(","):
                break
        c.expect(")")

    def postfix(self) -> None:
        c = self.c
        while True:
            t = c.peek()
            if t == ".":
                c.next()
                self.member()
            elif t == "?.":
                c.next()
                if c.peek() == "(":
                    self.args()
                elif c.peek() == "[":
                    c.next()
                    self.expression()
                    c.expect("]")
                else:
                    self.member()
            elif t == "(":
                self.args()
            elif t == "[":
                c.next()
                self.expression()
                c.expect("]")
            elif t == "T":
                c.next()
            elif t in ("++", "--") and not c.new_line():
                c.next()
            else:
                return

    # statements
    def end(self) -> None:
        """The end of a statement: a semicolon, the end, or a new line."""
        c = self.c
        if not (c.accept(";") or c.done() or c.new_line()):
            raise Bad

    def statements(self, stop: int | None = None) -> str:
        """All tokens as statements; the kind of the last one."""
        kind = "empty"
        while not self.c.done():
            kind = self.statement(kind)
        return kind

    def declare(self) -> None:
        while True:
            self.binding()
            if not self.c.accept(","):
                return

    def statement(self, before: str = "other") -> str:
        c = self.c
        t = c.peek()
        if t == ";":
            c.next()
            return "other"
        if t in ("var", "const") or t == "let" and (self.is_name(c.peek(1)) or c.peek(1) in ("[", "B")):
            c.next()
            self.declare()
        elif t in ("case", "default"):
            self.label()
            return "other"
        elif self.is_name(t) and c.peek(1) == ":":
            c.i += 2
            return self.statement() if not c.done() else "other"
        elif t == "if":
            c.next()
            self.condition()
            self.body()
            return "if"
        elif t == "else":
            c.next()
            inner = self.body()
            return "elif" if inner == "if" else "other"
        elif t in ("while", "for", "with"):
            self.loop_head()
            self.body()
            return "other"
        elif t == "do":
            c.next()
            self.body()
            c.expect("while")
            self.condition()
            c.accept(";")
            return "other"
        elif t == "return":
            c.next()
            if not (c.done() or c.new_line() or c.peek() == ";"):
                self.expression()
        elif t == "throw":
            c.next()
            if c.new_line():
                raise Bad
            self.expression()
        elif t in ("break", "continue"):
            c.next()
            if not c.new_line() and c.peek() == "n":
                c.next()
        elif t == "debugger":
            c.next()
        elif t == "import" and c.peek(1) not in ("(", "."):
            c.next()
            if not c.accept("S"):
                while True:
                    if c.accept("*"):
                        c.expect("n")  # as
                        c.expect("n")
                    elif not c.accept("B"):
                        if not self.is_name(c.next()):
                            raise Bad
                    if not c.accept(","):
                        break
                c.expect("n")  # from
                c.expect("S")
        elif t == "export":
            c.next()
            if c.accept("default"):
                self.expr()
            elif c.accept("*"):
                if c.accept("n") and c.peek() == "n":
                    c.next()
                    c.expect("n")
                c.expect("S")
            elif c.accept("B"):
                if c.accept("n"):
                    c.expect("S")
            else:
                if c.peek() not in ("var", "let", "const"):
                    raise Bad
                return self.statement()
        else:
            self.expression()
        self.end()
        return "other"

    def body(self) -> str:
        if self.c.done():
            raise Bad
        return self.statement()

    def label(self) -> None:
        c = self.c
        if c.next() == "case":
            self.expression()
        c.expect(":")

    def condition(self) -> None:
        self.c.expect("(")
        self.expression()
        self.c.expect(")")

    def loop_head(self) -> None:
        c = self.c
        if c.next() != "for":
            self.condition()
            return
        c.accept("await")
        c.expect("(")
        if c.peek() != ";":
            if c.peek() in ("var", "let", "const"):
                c.next()
                self.pattern()
                if c.peek() not in ("of", "in"):
                    if c.accept("="):
                        self.expr(no_in=True)
                    while c.accept(","):
                        self.binding()
            else:
                self.expr(no_in=True)
                while c.accept(","):
                    self.expr(no_in=True)
        if c.accept("of", "in"):
            self.expression()
        else:
            c.expect(";")
            if c.peek() != ";":
                self.expression()
            c.expect(";")
            if c.peek() != ")":
                self.expression()
        c.expect(")")

    def block_head(self) -> str:
        c = self.c
        if c.done():
            return "other"
        t = c.peek()
        if t in ("case", "default"):
            self.label()
            return self.block_head()
        if self.is_name(t) and c.peek(1) == ":":
            c.i += 2
            return self.block_head()
        if t == "else":
            c.next()
            inner = self.block_head()
            return "elif" if inner == "if" else "other"
        if t == "if":
            c.next()
            self.condition()
            inner = self.block_head()
            return "if" if inner in ("other", "if") else inner
        if t in ("while", "for", "with"):
            self.loop_head()
            return self.block_head() if not c.done() else "other"
        if t in ("do", "try", "finally"):
            c.next()
            self.finish()
            return t
        if t == "catch":
            c.next()
            if c.accept("("):
                self.pattern()
                c.expect(")")
            self.finish()
            return "catch"
        if t == "switch":
            c.next()
            self.condition()
            self.finish()
            return "switch"
        if t == "export":
            c.next()
            if c.accept("default") and c.peek() not in ("function", "class", "async"):
                raise Bad
            t = c.peek()
        if t == "async" and c.peek(1) == "function":
            c.next()
            t = "function"
        if t == "function":
            c.next()
            c.accept("*")
            if self.is_name(c.peek()):
                c.next()
            self.params()
            self.finish()
            return "other"
        if t == "class":
            c.next()
            if self.is_name(c.peek()):
                c.next()
            if c.accept("extends"):
                self.operand_lhs()
            self.finish()
            return "class"
        raise Bad

    def key(self) -> None:
        c = self.c
        if c.accept("["):
            self.expr()
            c.expect("]")
        else:
            c.accept("#")
            t = c.next()
            if t not in ("S", "0") and not self.WORDS.fullmatch(t):
                raise Bad

    def method_head(self) -> None:
        c = self.c
        while c.peek() in ("static", "async", "get", "set", "*") and c.peek(1) not in ("(", "=", ""):
            c.next()
        self.key()
        self.params()

    def fields(self) -> None:
        """Fields of a class, each ended by a new line, a semicolon or the end."""
        c = self.c
        while not c.done():
            if c.accept(";"):
                continue
            while c.peek() == "static" and c.peek(1) not in ("", "=", ";"):
                c.next()
            self.key()
            if c.accept("="):
                self.expr()
            self.end()

    _CLASS_END = re.compile(r"\bclass\b[^;{}()=,]*(?:\([^()]*\))?$")

    @classmethod
    def opens(cls, ctx: str, text: str) -> tuple[str, str, str]:
        lines = [m.start() for m in re.finditer("\n", text)]
        if ctx in ("file", "block", "switch"):
            for at in [0, *reversed(lines)]:
                tail = cls(text[at:])
                try:
                    kind = tail.block_head()
                    if at:
                        head = cls(text[:at])
                        last = head.statements()
                        if kind == "other" and not text[at:].strip():
                            continue  # a brace alone continues the line before
                        if text[at:].lstrip().startswith(("else", "catch", "finally")) and last not in ("if", "elif"):
                            raise Bad
                    inner = {"switch": "switch", "class": "class"}.get(kind, "block")
                    return inner, ("other" if kind in ("switch", "class") else kind), "stmt"
                except Bad:
                    continue
        elif ctx == "class":
            for at in [0, *reversed(lines)]:
                tail = cls(text[at:])
                try:
                    if text[at:].strip() == "static":
                        pass
                    else:
                        tail.method_head()
                        tail.finish()
                    if at:
                        cls(text[:at]).fields()
                    return "block", "other", "stmt"
                except Bad:
                    continue
        elif ctx == "names":
            raise Bad
        toks = Cursor(text).toks
        last = toks[-1] if toks else ""
        if last == "=>":
            return "block", "other", "expr"
        if toks and toks[0] in ("import", "export") and last in ("import", "export", ","):
            return "names", "other", "expr"
        if last == ")":
            return "block", "other", "expr"  # function or method; the statement is parsed when it ends
        if cls._CLASS_END.search(text):
            return "class", "other", "expr"
        if ctx == "object" and last == "":
            raise Bad
        if last in ("=", "(", ",", "[", ":", "?", "return", "...", "var", "let", "const", "default", "of", "in", "await",
                    "yield", "typeof", "!", "throw", "new", "case") or last in cls.BINARY or last == ">":
            return "object", "other", "expr"
        raise Bad

    @classmethod
    def ends(cls, ctx: str, text: str) -> str:
        p = cls(text)
        if ctx in ("object", "names"):
            raise Bad
        if ctx == "class":
            p.fields()
            return "other"
        if not text:
            return "other"
        # the semicolon may be the body of what stands before it
        p.c.toks.append(";")
        p.c.line.append(False)
        kind = p.statements()
        return "other" if kind == "empty" else kind

    @classmethod
    def closes(cls, ctx: str, text: str) -> None:
        p = cls(text)
        c = p.c
        if ctx == "object":
            while not c.done():
                if c.accept("..."):
                    p.expr()
                else:
                    start = c.i
                    try:
                        while c.peek() in ("async", "get", "set", "*") and c.peek(1) not in ("(", ":", ",", "", "="):
                            c.next()
                        p.key()
                        p.params()
                        c.expect("B")
                    except Bad:
                        c.i = start
                        p.key()
                        if c.accept(":"):
                            p.expr()
                        elif c.accept("="):
                            p.expr()
                if not c.accept(","):
                    p.finish()
        elif ctx == "names":
            while not c.done():
                if not (c.accept("S") or cls.WORDS.fullmatch(c.next())):
                    raise Bad
                if c.accept("n"):
                    c.next()
                if not c.accept(","):
                    p.finish()
        elif ctx == "class":
            p.fields()
        elif text:
            p.statements()

    @classmethod
    def at_end(cls, text: str) -> None:
        cls(text).statements()


_FOLLOWS = {"else": ("if", "elif"), "catch": ("try", "tryr", "catch"), "finally": ("try", "tryr", "catch")}
_LINE = re.compile(r"[ \t]*\n\s*")
_BLANK = re.compile(r"[ \t\f\r]+")
_ANY_BLANK = re.compile(r"\s+")
_SAME = re.compile(r"(?:(?:[nS]: ?)?\bB ?,\s*){2,}(?=(?:[nS]: ?)?B?\s*$)")
_FIRST = re.compile(r"[a-z]+")
_MEMO: dict[tuple, object] = {}


def _ask(grammar, question: str, ctx: str, text: str):
    """The grammar's answer, or None if it rejects the text; each text is parsed once."""
    key = (grammar, question, ctx, text)
    if key in _MEMO:
        return _MEMO[key]
    try:
        answer = getattr(grammar, question)(ctx, text)
        if answer is None:
            answer = True
    except (Bad, RecursionError):
        answer = None
    if len(_MEMO) > 300_000:
        _MEMO.clear()
    _MEMO[key] = answer
    return answer


def check(skeleton: str, grammar) -> bool:
    """Whether the skeleton of a file is valid."""
    if "\x01" in skeleton or "\x00" in skeleton:
        return False
    if grammar is Java:
        text = _ANY_BLANK.sub(" ", skeleton)
    else:
        text = _LINE.sub("\n", _BLANK.sub(" ", skeleton))
    text = _RUN.sub("", text)
    parts = _CUT.split(text)
    stack: list[tuple[str, str, str, str]] = []
    ctx, before, acc = "file", "other", ""
    for k in range(0, len(parts) - 1, 2):
        seg, brace = parts[k].strip(" "), parts[k + 1]
        acc = acc + " " + seg if acc else seg
        if brace == ";" and acc.count("(") > acc.count(")"):
            acc += ";"
            continue
        body = acc.strip()
        first = _FIRST.match(body)
        if first:
            word = first.group()
            need = _FOLLOWS.get(word)
            if need:
                if before not in need:
                    return False
            elif before == "try" or before == "do" and word != "while":
                return False
        elif before in ("try", "do"):
            return False
        if brace == ";":
            kind = _ask(grammar, "ends", ctx, body)
            if kind is None:
                return False
            if kind == "enum":
                ctx, kind = "class", "other"
            before, acc = str(kind), ""
        elif brace == "{":
            answer = _ask(grammar, "opens", ctx, body)
            if answer is None:
                return False
            inner, kind, mode = answer
            stack.append((ctx, kind, mode, acc))
            ctx, before, acc = inner, "other", ""
        else:
            if not stack or _ask(grammar, "closes", ctx, body) is None:
                return False
            ctx, kind, mode, outer = stack.pop()
            if mode == "stmt":
                before, acc = kind, ""
            else:
                before, acc = "other", (outer + " B").strip(" ")
                if len(acc) > 60 and ctx in ("object", "array"):
                    acc = _SAME.sub("", acc)  # members that were checked with those before
    tail = parts[-1].strip()
    acc = (acc + " " + tail).strip() if acc else tail
    if stack or before in ("try", "do"):
        return False
    try:
        grammar.at_end(acc)
    except (Bad, RecursionError):
        return False
    return True
