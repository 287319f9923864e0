"""One verdict for a whole file."""

from __future__ import annotations

import warnings

from graphloom.llm.syntax import brace_grammar, data_grammar, python_grammar
from graphloom.llm.syntax.lexing import CODE, LANGUAGES, UNKNOWN, brackets, chunks, compose, skeleton

GRAMMARS = {"java": brace_grammar.Java, "javascript": brace_grammar.JavaScript}
CHECKED = ("python", "java", "javascript", "json", "xml")
#: Languages whose files are cut into chunks.
CUT = (*LANGUAGES, "json")
#: How many characters of a file the lexer reads at a time.
STEP = 4096


def normal(text: str) -> str:
    """Line ends as \\n and no byte-order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.removeprefix("\ufeff")


def shape_of(part: str, language: str, state: str) -> tuple[str, str]:
    """(skeleton, state at the end) of a chunk that is entered in ``state``."""
    if language == "json":
        return data_grammar.json_skeleton(part), CODE
    return skeleton(part, LANGUAGES[language], state)


def statements_valid(shape: str, language: str) -> bool:
    """The verdict of the local grammar on a skeleton whose brackets match."""
    if not shape.strip():
        return True
    if language == "json":
        return data_grammar.json_value(shape)
    if language == "python":
        return python_grammar.check(shape)
    return brace_grammar.check(shape, GRAMMARS[language])


def fold(text: str, language: str, step: int = STEP) -> tuple[str, str, str | None]:
    """(skeleton, state at the end, bracket summary) of a text by its chunks from left to right."""
    state, summary = CODE, ""
    shapes = []
    for part in chunks(text, step):
        shape, state = shape_of(part, language, state)
        shapes.append(shape)
        summary = compose(summary, brackets(shape))
    return "".join(shapes), state, summary


def python_exact(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", 0x400, dont_inherit=True)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


def confirmed(text: str, language: str) -> bool:
    """Whether a text is valid although the local grammar rejects it: Python's exact parser decides."""
    return language == "python" and python_exact(text)


def valid(text: str | None, language: str, step: int = STEP) -> bool:
    """Whether ``text`` is valid in ``language``, one of CHECKED; null is valid."""
    if text is None:
        return True
    if language == "xml":
        return data_grammar.check_xml(text)
    text = normal(text)
    if language == "json" and data_grammar.starts_with_comment(text):
        return data_grammar.check_json(text)
    shape, end, summary = fold(text, language, step)
    return end == CODE and summary == "" and statements_valid(shape, language) or confirmed(text, language)


__all__ = ["CHECKED", "CUT", "UNKNOWN", "confirmed", "normal", "shape_of", "statements_valid", "valid"]
