"""JSON and XML: tokens, brackets and tags, checked in one pass over a file."""

from __future__ import annotations

import re
import xml.parsers.expat

_JSON_COMMENT = re.compile(r"\s*(?://[^\n]*|/\*[\s\S]*?\*/|#[^\n]*)\s*")
_JSON_TOKEN = re.compile(
    r'[ \t\r\n]+|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")'
    r"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-])|(?:true|false|null)(?!\w))|([\[\]{}:,])|(.)",
    re.S,
)
_XML_COMMENT = re.compile(r"\s*<!--[\s\S]*?-->\s*|\s+")
_NAME = r"[^\W\d][\w.:-]*"
_ATTRIBUTE = re.compile(rf"\s+({_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_MARKUP = re.compile(
    rf"<!--(?:[^-]|-(?!-))*-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?(?P<pi>{_NAME})(?:\s[\s\S]*?)?\?>"
    rf"|<!DOCTYPE(?:[^<>\[\]\"']|\"[^\"]*\"|'[^']*'|\[[\s\S]*?\]\s*)*>"
    rf"|</(?P<close>{_NAME})\s*>|<(?P<open>{_NAME})(?P<attrs>(?:{_ATTRIBUTE.pattern.replace('(' + _NAME + ')', _NAME, 1).replace('(', '(?:', 1)})*)\s*(?P<empty>/?)>|<"
)
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)")


def only_comments(text: str, pattern: re.Pattern) -> bool:
    at = 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            return False
        at = m.end()
    return True


def starts_with_comment(text: str) -> bool:
    return text.lstrip()[:1] in ("/", "#")


def json_skeleton(text: str) -> str:
    """The marks of a run of whole lines, strings as S, numbers and words as 0, and ! for what no value holds."""
    return "".join(
        ["!" if bad else "S" if string else "0" if literal else mark for string, literal, mark, bad in _JSON_TOKEN.findall(text)]
    )


def json_value(shape: str) -> bool:
    """Whether a skeleton is one value or nothing. What may follow is kept as a state with a stack of brackets."""
    stack: list[str] = []
    want = "value" if shape else "end"  # value, first (of an array), key, firstkey, colon, comma, end
    for token in shape:
        if token in "S0":
            if token == "S" and want in ("key", "firstkey"):
                want = "colon"
            elif want in ("value", "first"):
                want = "comma" if stack else "end"
            else:
                return False
        elif token in "[{":
            if want not in ("value", "first"):
                return False
            stack.append(token)
            want = "first" if token == "[" else "firstkey"
        elif token == "]":
            if not stack or stack.pop() != "[" or want not in ("first", "comma"):
                return False
            want = "comma" if stack else "end"
        elif token == "}":
            if not stack or stack.pop() != "{" or want not in ("firstkey", "comma"):
                return False
            want = "comma" if stack else "end"
        elif token == ":":
            if want != "colon":
                return False
            want = "value"
        elif token == ",":
            if want != "comma":
                return False
            want = "value" if stack[-1] == "[" else "key"
        else:
            return False
    return want == "end"


def check_json(text: str) -> bool:
    """Whether a text is one JSON value, nothing, or comments only."""
    return json_value(json_skeleton(text)) or only_comments(text, _JSON_COMMENT)


def _exact_xml(text: str) -> bool:
    parser = xml.parsers.expat.ParserCreate()
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except xml.parsers.expat.ExpatError:
        return False
    return True


def _tags_fit(text: str) -> bool:
    stack: list[str] = []
    roots = 0
    at = 0
    doctype = "<!DOCTYPE" in text
    for m in _MARKUP.finditer(text):
        between = text[at : m.start()]
        at = m.end()
        if between.strip() and (not stack or "]]>" in between or (not doctype and _ENTITY.search(between))):
            return False
        token = m.group()
        if token == "<":
            return False
        if m["pi"] and m["pi"].lower() == "xml" and m.start():
            return False
        if m["close"]:
            if not stack or stack.pop() != m["close"]:
                return False
        elif m["open"]:
            if not stack:
                roots += 1
            names = [a[0] for a in _ATTRIBUTE.findall(m["attrs"])]
            if len(names) != len(set(names)) or (not doctype and _ENTITY.search(m["attrs"])):
                return False
            if not m["empty"]:
                stack.append(m["open"])
    return roots == 1 and not stack and not text[at:].strip()


def check_xml(text: str) -> bool:
    """Whether a text is well formed; what the tags reject is confirmed by the exact parser."""
    if only_comments(text, _XML_COMMENT):
        return True
    return _tags_fit(text) or _exact_xml(text)
