"""Chunks of a source file as maps from lexer states, and their associative reduction.

A chunk is a run of whole lines. For each state in which the lexer may enter it
(in code, in a block comment, in a string over several lines, in a template and its
nested expressions), its map tells the state at its end and its summary of brackets: the closing ones that nothing in
the chunk opens, then the opening ones that nothing in it closes. Maps compose,
and the composition is associative, so the chunks of one file can be reduced in
any grouping. Once the state at the start of every chunk is known, a chunk is
rewritten as a skeleton: comments are gone, a string is one mark, a number is 0
and a name is n, while keywords, operators and line ends stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

CODE = "code"
STRING, TEMPLATE = "\x02", "\x03"  # marks that no name can be mistaken for; S and T in the skeleton
BAD = "\x01"  # a character that no lexer accepts: an open string, a stray quote
_OPEN = {")": "(", "]": "[", "}": "{"}
_BRACKETS = re.compile(r"[()\[\]{}]")
_WORD = re.compile(r"((?:[^\W\d]|\$)[\w$]*|0[xXbBoO]\w*|(?:\d|\.(?=\d))(?:[eE][+-]|[\w.])*)")
_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*|0[bB][01](?:_*[01])*|0[oO][0-7](?:_*[0-7])*"
    r"|(?:\d(?:_*\d)*)?\.?(?:\d(?:_*\d)*)?(?:[eE][+-]?\d(?:_*\d)*)?)[jJlLfFdDn]?"
)


@dataclass(frozen=True)
class Language:
    """How one language is lexed: the token pattern, how to render a token, and where multi-line states end."""

    name: str
    tokens: re.Pattern
    keywords: frozenset[str]
    ends: dict[str, re.Pattern]
    string: str


def _py_string(quote: str) -> str:
    return rf"{quote}[^{quote}\\\n]*(?:\\[\s\S][^{quote}\\\n]*)*{quote}"


def _py_long(quote: str) -> str:
    return rf"{quote * 3}[^{quote}\\]*(?:(?:\\[\s\S]|{quote}(?!{quote * 2}))[^{quote}\\]*)*{quote * 3}"


PYTHON = Language(
    "python",
    re.compile(
        r"#[^\n]*|(?:\b[rRbBfFuU]{1,2})?(?:%s|%s|\"\"\"|'''|%s|%s|[\"'])"
        % (_py_long('"'), _py_long("'"), _py_string('"'), _py_string("'"))
    ),
    frozenset(
        "False None True and as assert async await break class continue def del elif else except finally for from "
        "global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
    ),
    {'"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''")},
    '""',
)
JAVA = Language(
    "java",
    re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\"\"\"[ \t]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"\"\"[ \t]*\n"
        r"|\"(?:[^\"\\\n]|\\[btnfrs\"'\\0-7]|\\u+[0-9a-fA-F]{4})*\""
        r"|'(?:[^'\\\n]|\\[btnfrs\"'\\]|\\[0-7]{1,3}|\\u+[0-9a-fA-F]{4})'|[\"'`#\\]"
    ),
    frozenset(
        "abstract assert boolean break byte case catch char class continue default do double else enum extends final "
        "finally float for if implements import instanceof int interface long native new package private protected "
        "public record return short static strictfp super switch synchronized this throw throws transient try void volatile "
        "while true false null goto const yield".split()
    ),
    {"/*": re.compile(r"[\s\S]*?\*/"), '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""')},
    STRING,
)
JAVASCRIPT = Language(
    "javascript",
    re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
        r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`|`"
        r"|(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};] )|(?<=return )|(?<=\n    ))"
        r"/(?![*/ ])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[dgimsuvy]*|[\"'\\@]"
    ),
    frozenset(
        "async await break case catch class const continue debugger default delete do else export extends false finally "
        "for function if import in instanceof let new null of return static super switch this throw true try typeof var "
        "void while with yield get set".split()
    ),
    # a template's state is the stack of what is open; deeper ones are found where they occur
    {"/*": re.compile(r"[\s\S]*?\*/"), **dict.fromkeys(("`", "`{", "`{`", "`{`{", "`!"))},
    STRING,
)
LANGUAGES = {x.name: x for x in (PYTHON, JAVA, JAVASCRIPT)}


_REST = {c: re.compile(rf"[^{c}\\\n]*(?:\\[\s\S][^{c}\\\n]*)*{c}") for c in "\"'"}
_IN_TEMPLATE = re.compile(r"[\\`$]")
_IN_EXPRESSION = re.compile(r"[\\\"'`{}]")


def _template(text: str, at: int, stack: str) -> tuple[int, str]:
    """The end of the template literal that is open at ``at``, or -1 and what is still open at the end of the text."""
    while True:
        m = (_IN_TEMPLATE if stack[-1] == "`" else _IN_EXPRESSION).search(text, at)
        if m is None:
            return -1, stack
        c, at = m.group(), m.end()
        if c == "\\":
            at += 1
        elif c == "$":
            if text.startswith("{", at):
                stack += "{"
                at += 1
        elif c == "`" and stack[-1] == "`" or c == "}":
            stack = stack[:-1]
            if not stack:
                return at, ""
        elif c in "`{":
            stack += c
        else:
            close = _REST[c].match(text, at)
            if close is None:
                return -1, "`!"
            at = close.end()


def strip_text(text: str, lang: Language, state: str = CODE) -> tuple[str, str]:
    """(text without comments and with marks for strings, state at the end)."""
    out: list[str] = []
    # a chunk follows a line end; what may begin a regular expression looks back at it
    text = "\n" + text
    at = 1
    if state == "`!":
        return "", state
    if state[0] == "`":
        at, state = _template(text, 1, state)
        if at < 0:
            return "", state
    elif state != CODE:
        end = lang.ends[state].match(text, 1)
        if end is None:
            return "", state
        at = end.end()
    for m in lang.tokens.finditer(text, at):
        if m.start() < at:
            continue
        token = m.group()
        out.append(text[at : m.start()])
        at = m.end()
        first = token[0]
        if first == "#" and lang is PYTHON:
            continue
        if first == "/":
            if token.startswith("//"):
                continue
            if token.startswith("/*"):
                if token == "/*":
                    return "".join(out), "/*"
                out.append("\n" if "\n" in token else " ")
                continue
            out.append(STRING)  # a regular expression
        elif token == "`" and lang is JAVASCRIPT:
            out.append(TEMPLATE)
            end, left = _template(text, m.end(), "`")
            if end < 0:
                return "".join(out), left
            at = end
        elif first == "`" and len(token) > 1:
            out.append(TEMPLATE)
        elif lang is PYTHON and token.lstrip("rRbBfFuU") in lang.ends:
            out.append('""')
            return "".join(out), token[-3:]
        elif lang is JAVA and token.startswith('"""') and not token.endswith('"""'):
            out.append(STRING)
            return "".join(out), '"""'
        elif len(token.lstrip("rRbBfFuU")) == 1:
            out.append(token if token == "@" or token == "\\" and lang is PYTHON else BAD)
        else:
            mark = lang.string
            if lang is PYTHON and "b" in token[:2].lower().split('"')[0].split("'")[0]:
                mark = 'b""'
            out.append(mark)
    out.append(text[at:])
    return "".join(out), CODE


def skeleton(text: str, lang: Language, state: str = CODE) -> tuple[str, str]:
    """(skeleton, state at the end) of a chunk that is entered in ``state``."""
    bare, end = strip_text(text, lang, state)
    pieces = _WORD.split(bare)
    keep = lang.keywords
    pieces[1::2] = [
        w
        if w in keep
        else ("n" if w[0] not in "0123456789." else ("0" if _NUMBER.fullmatch(w) else BAD))
        for w in pieces[1::2]
    ]
    if lang is PYTHON:
        # the marks of bytes are no names
        return "".join(pieces).replace('n""', 'b""'), end
    return "".join(pieces).replace(STRING, " S ").replace(TEMPLATE, " T "), end


def brackets(text: str) -> str | None:
    """What remains of the brackets of a text after matching ones are removed; None if two don't match."""
    closers: list[str] = []
    stack: list[str] = []
    for b in _BRACKETS.findall(text):
        if b in "([{":
            stack.append(b)
        elif stack:
            if stack.pop() != _OPEN[b]:
                return None
        else:
            closers.append(b)
    return "".join(closers) + "".join(stack)


def compose(left: str | None, right: str | None) -> str | None:
    """The summary of two neighbouring chunks; associative, with None as zero and '' as one."""
    if left is None or right is None:
        return None
    return brackets(left + right)


def chunk_map(text: str, lang: Language) -> dict[str, tuple[str, str | None]]:
    """The state at the end and the bracket summary of a chunk, for each state at its start."""
    out = {}
    for state in (CODE, *lang.ends):
        bare, end = strip_text(text, lang, state)
        out[state] = (end, brackets(bare))
    return out


UNKNOWN = "?"  # the state behind a template that is nested deeper than the maps go


def compose_maps(left: dict, right: dict) -> dict:
    after = {s: right.get(e, (UNKNOWN, None)) for s, (e, _) in left.items()}
    return {s: (after[s][0], compose(b, after[s][1])) for s, (_, b) in left.items()}


def chunks(text: str, size: int) -> list[str]:
    """Runs of whole lines of about ``size`` characters; a line that ends with a backslash keeps its successor."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find("\n", start + size)
        while cut > 0 and text[cut - 1] == "\\":
            cut = text.find("\n", cut + 1)
        if cut < 0:
            break
        out.append(text[start : cut + 1])
        start = cut + 1
    out.append(text[start:])
    return out
