"""The local grammar of Python: logical lines and the blocks that their indentation makes."""

from __future__ import annotations

import re
import warnings

from graphloom.llm.syntax.lexing import brackets, compose

_LEAD = re.compile(r"[a-z]+|@")
#: a run of literals between commas counts as one; not where a colon follows or stands before
_LITERALS = re.compile(r'(?<![\w":])(?<!: )(?:(?:0|"")[ \t]*,[ \t]*)+(?=(?:0\b|"")[ \t]*[,)\]}])')
_MEMO: dict[str, tuple[bool, str, bool]] = {}
_SUMMARY: dict[str, str | None] = {}
#: what the statement before may be, for those that continue one
_AFTER = {
    "elif": {"if", "elif"},
    "else": {"if", "elif", "for", "while", "except"},
    "except": {"try", "except"},
    "finally": {"try", "except", "tryelse"},
}
_BEFORE = {"elif": "if n:\n pass\n", "else": "if n:\n pass\n", "except": "try:\n pass\n", "finally": "try:\n pass\n"}


def _parses(source: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(source, "<line>", "exec", 0x400, dont_inherit=True)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


def statement(line: str) -> tuple[bool, str, bool]:
    """(valid, leading keyword, whether a block must follow) of one logical line."""
    known = _MEMO.get(line)
    if known is not None:
        return known
    m = _LEAD.match(line)
    lead = m.group() if m else ""
    if lead == "async":
        lead = (_LEAD.match(line[5:].lstrip()) or [""])[0]
    before = _BEFORE.get(lead, "")
    if lead == "@":
        result = (_parses(line + "\ndef n(): pass"), lead, False)
    elif lead == "case" and _parses(f"match n:\n {line}\n  pass"):
        result = (True, lead, True)
    elif lead == "case" and _parses(f"match n:\n {line}"):
        result = (True, lead, False)
    elif lead == "match" and _parses(f"{line}\n case n:\n  pass"):
        result = (True, lead, True)
    elif _parses(before + line):
        result = (True, lead, False)
    elif lead == "try":
        result = (_parses(line + "\n pass\nfinally:\n pass"), lead, True)
        if not result[0]:
            result = (_parses(line + "\nfinally:\n pass"), lead, False)
    else:
        result = (_parses(before + line + "\n pass"), lead, True)
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    _MEMO[line] = result
    return result


def check(skeleton: str) -> bool:
    """Whether the skeleton of a file is valid."""
    if "\x01" in skeleton or "\x00" in skeleton:
        return False
    if "\\\n" in skeleton:
        skeleton = skeleton.replace("\\\n", " ")
    # widths with tabs of eight and of one column: an indentation must compare alike by both
    levels: list[tuple[int, int]] = [(0, 0)]
    last: list[str] = [""]  # the statement before, at each level
    expect = False
    decorated = False
    held = ""
    held_indent = ""
    open_brackets: str | None = ""
    for raw in skeleton.split("\n"):
        body = raw.strip(" \t\f")
        if not body:
            continue
        if "," in body:
            body = _LITERALS.sub("", body)
        summary = _SUMMARY.get(body, "?")
        if summary == "?":
            summary = brackets(body)
            if len(_SUMMARY) > 200_000:
                _SUMMARY.clear()
            _SUMMARY[body] = summary
        if open_brackets:
            held += " " + body
            open_brackets = compose(open_brackets, summary)
            if open_brackets is None or open_brackets[:1] in (")", "]", "}"):
                return False
            if open_brackets:
                continue
            line, indent = _LITERALS.sub("", held), held_indent
        else:
            indent = raw[: len(raw) - len(raw.lstrip(" \t\f"))]
            if summary is None or summary[:1] in (")", "]", "}"):
                return False
            if summary:
                held, held_indent, open_brackets = body, indent, summary
                continue
            line = body
        indent = indent.rpartition("\f")[2]
        width = (len(indent.expandtabs(8)), len(indent))
        if expect:
            if width[0] <= levels[-1][0] or width[1] <= levels[-1][1]:
                return False
            levels.append(width)
            last.append("")
            expect = False
        elif width[0] > levels[-1][0]:
            return False
        else:
            while width[0] < levels[-1][0]:
                levels.pop()
                if last.pop() == "try" or decorated:
                    return False
            if width != levels[-1]:
                return False
        valid, lead, opens = statement(line)
        if not valid:
            return False
        if decorated and lead not in ("def", "class", "@"):
            return False
        before = last[-1]
        if lead in _AFTER:
            if before not in _AFTER[lead]:
                return False
            if lead == "else":
                lead = "tryelse" if before == "except" else "end"
        elif before == "try":
            return False
        last[-1] = lead
        decorated = lead == "@"
        expect = opens
    return not (expect or decorated or open_brackets or "try" in last)
