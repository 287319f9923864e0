"""Lexical tokens of lines that may hold a credential, with the features of each.

A token knows the characters of the file that it consists of. The content of a
literal without white space is one token, and so are neighbouring literals that
are joined; a connection string, an address or a sentence is several.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

Span = tuple[int, int]

PEM = re.compile(r"-----BEGIN (?P<type>[A-Z0-9 ]*?)-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*-----")
_PEM_LINES = re.compile(r"(?:[\s\"'+,()]|\\n)*+(?:[A-Za-z0-9+/]{16,}+=*+(?:[\s\"'+,()]|\\n)*+)*+")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
# what may lie between literals that are one string: a sign, or a line end
_BETWEEN = r"[^\S\n]*+(?:\n\s*+(?:\+\s*+)?+|\+\s*+)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
_JOINED = re.compile(rf"{_DOUBLE}(?:{_BETWEEN}{_DOUBLE})++|{_SINGLE}(?:{_BETWEEN}{_SINGLE})++")
_LITERAL = re.compile(r""""((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'""")
_SCAN = re.compile(
    r"""(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)"""
    r"""|(?P<url>[A-Za-z][\w+.-]*://[^\s"'`<>]+)|(?P<com>//|/\*|<!--|(?<!\S)\#|(?<!\S)\*(?!\S))"""
    r"""|(?P<word>[^\s"'`,;(){}\[\]<>=:|]+)|(?P<op>[,;(){}\[\]<>=:|]+|["'`])"""
)
_URL = re.compile(r"(?P<head>[A-Za-z][\w+.-]*://)(?:(?P<user>[^\s/:@?#]*)(?P<mid>:)(?P<pass>[^\s/?#]*)@)?(?P<rest>[^?\s]*)(?P<query>\?\S*)?")
_PARAM = re.compile(r"([\w.-]+)=([^&#\s]*)")
_PAIRS = re.compile(r"^\s*[\w .-]+=[^;=]*(?:;[\w .-]+=[^;]*)+;?\s*$")
_PAIR = re.compile(r"([\w .-]+)=([^;]*)")
_CONFIG = re.compile(r"^(?P<lead>\s*(?:[#!;]\s*|-\s+|export\s+)?)(?P<key>[\w.-]+)(?P<mid>\s*[:=]\s*)(?P<value>\S.*?)\s*$")
_XML_NAMED = re.compile(r"""\b(?:name|key|id)\s*=\s*["']([^"']*)["'][^<>]*?\bvalue\s*=\s*["']([^"']*)["']""")
_XML_TEXT = re.compile(r"<([A-Za-z][\w.:-]*)[^<>]*>([^<>]*)</")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z]+")


@dataclass
class Token:
    text: str
    spans: list[Span]
    kind: str  # value, word, key, op, pass, user, param, addr, pem
    key: str = ""
    env_key: bool = False
    marks: list[str] = field(default_factory=list)


# -- names ---------------------------------------------------------------------
_SECRET = frozenset(
    "password passwd passphrase pass pwd pw secret secrets token credential credentials kennwort passwort clave "
    "contrasena contraseña passcode pin apikey authtoken motdepasse senha".split()
)
_SECRET_KEY = frozenset("api access private signing secret encryption auth master client service account license hmac".split())
#: Spanish "clave" is any key; with these words, or alone, it is a secret one.
_OF_CLAVE = frozenset("api acceso secreta privada maestra admin db smtp ldap".split())
_ABOUT = frozenset(
    "length limit type field file path hint count size ttl expiry expires rotation policy budget min max name id env days "
    "letters label url format mode class retries timeout".split()
)
_DIGEST = frozenset("sha sha1 sha256 sha512 checksum digest hash md5 integrity commit etag fingerprint revision crc".split())
_PUBLIC = frozenset("public trust anchor cert certificate ca".split())
_LINK = frozenset("url uri dsn jdbc callback hook webhook upstream remote endpoint link href".split())


def key_class(name: str) -> str:
    """What a name says about its value."""
    words = [w.lower() for w in _CAMEL.split(name) if w]
    if not words:
        return "none"
    marks = set(words)
    if "clave" in marks and len(words) > 1 and not marks & _OF_CLAVE:
        marks.discard("clave")
    secret = bool(marks & _SECRET) or (
        any(w in ("key", "keys") and k and words[k - 1] in _SECRET_KEY for k, w in enumerate(words))
    )
    if secret:
        return "about" if words[-1] in _ABOUT else "secret"
    if marks & _DIGEST:
        return "digest"
    if words[-1] in ("id", "uuid", "guid"):
        return "id"
    if words[-1] in ("key", "keys"):
        return "key"
    if words[-1] in ("auth", "authorization", "authorisation", "header", "bearer"):
        return "header"
    if marks & _PUBLIC:
        return "public"
    if words[-1] in _LINK:
        return "link"
    return "other"


# -- values --------------------------------------------------------------------
_REFERENCE = re.compile(
    r"^\$\{?[\w.:-]*\}?$|^\{\{.*\}\}$|^<[^<>]*>$|^&lt;.*&gt;$|^%\w+%$|^%\(\w+\)s$|^\$\(.*\)$|^(?:process\.env|os\.environ|env)\b"
    r"|^(?:vault|env|file|secret|ssm|arn)[:/].*",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^(?:change[-_ ]?(?:me|it|this)|not[-_ ]?set|unset|none|null|nil|todo|tbd|n/?a|dummy|fake|example|sample|placeholder"
    r"|redacted|removed|masked|default|test|testing|xxx+|[x*._•#-]+|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)"
    r"|replace[-_ ]?(?:me|this).*|insert[-_ ].*|enter[-_ ].*|put[-_ ].*|some[-_ ].*|secret|password|passwd|token)$",
    re.I,
)
_TYPED = re.compile(
    r"^(?:A(?:KI|SI)A[0-9A-Z]{16}|[a-z]{2,6}\d?[_-](?:(?:live|test|prod|pat|proj)[_-])?[A-Za-z0-9]{20,}"
    r"|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|xox[abeoprs]-[\w-]{10,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})$"
)
_JWT = re.compile(r"^eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]*)?$")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"^(?:0x)?[0-9a-f]{16,}$", re.I)
_TAGGED = re.compile(r"^(?:sha\d+|md5)[-:]", re.I)
_NUMBER = re.compile(r"^[-+]?[\d.,_]+(?:[eE][-+]?\d+)?[a-zA-Z%]{0,2}$")
_WORD = re.compile(r"^[A-Za-z]?[a-z]+$|^[A-Z]+$")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z]*(?:[-_.][A-Za-z]+)*\d{0,2}$")
_PATH = re.compile(r"^[~.]{0,2}/?[\w.-]+(?:/[\w.-]+)+/?$")
_WORDNUM = re.compile(r"^[A-Z]?[a-z]{2,}[^\sA-Za-z0-9]?\d{1,6}[^\s]{0,2}$|^[A-Z]?[a-z]{2,}[^\sA-Za-z0-9]\d+\S?$")
_BASE64 = re.compile(r"^[A-Za-z0-9+/_-]{24,}={0,2}$")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


def shape(text: str) -> str:
    if not text:
        return "empty"
    if _REFERENCE.match(text):
        return "reference"
    if _PLACEHOLDER.match(text) or len(set(text)) == 1:
        return "placeholder"
    if _TYPED.match(text):
        return "typed" if any(c.isdigit() for c in text) or text[:4] in ("AKIA", "ASIA") else "name"
    if _JWT.match(text):
        return "jwt"
    if _UUID.match(text):
        return "uuid"
    if _TAGGED.match(text):
        return "tagged"
    if _NUMBER.match(text):
        return "number"
    if _HEX.match(text):
        return "hex"
    if _WORD.match(text):
        return "word"
    digits = any(c.isdigit() for c in text)
    if _NAME.match(text) and not (digits and _BASE64.match(text)):
        lowers = sum(c.islower() for c in text)
        uppers = sum(c.isupper() for c in text)
        jumps = sum(a.islower() != b.islower() for a, b in zip(text, text[1:]))
        if not (len(text) >= 8 and lowers and uppers and jumps * 3 >= len(text)):
            return "name"
    if _PATH.match(text) and not (digits and len(text) >= 24 and entropy(text) > 4.2):
        return "path"
    if _BASE64.match(text) and digits and any(c.isupper() for c in text) and any(c.islower() for c in text):
        return "base64"
    if _WORDNUM.match(text):
        return "wordnum"
    kinds = digits + any(c.islower() for c in text) + any(c.isupper() for c in text) + any(not c.isalnum() for c in text)
    if len(text) >= 6 and kinds >= 3 or len(text) >= 12 and kinds >= 2 and digits:
        return "mixed"
    return "plain"


# -- tokens --------------------------------------------------------------------
def _url_tokens(text: str, at: int, key: str) -> list[Token]:
    out: list[Token] = []
    m = _URL.match(text)
    if not m:
        return [Token(text, [(at, at + len(text))], "value", key)]

    def add(name: str, kind: str, k: str = key) -> None:
        if m[name]:
            out.append(Token(m[name], [(at + m.start(name), at + m.end(name))], kind, k))

    add("head", "op")
    add("user", "user")
    add("mid", "op")
    add("pass", "pass")
    add("rest", "addr")
    if m["query"]:
        base = at + m.start("query")
        for p in _PARAM.finditer(m["query"]):
            out.append(Token(p[1], [(base + p.start(1), base + p.end(1))], "key", key))
            if p[2]:
                out.append(Token(p[2], [(base + p.start(2), base + p.end(2))], "param", p[1]))
    return out


def _content_tokens(text: str, at: int, key: str) -> list[Token]:
    """Tokens of a literal's content, or of a configuration value."""
    bare = text.strip()
    if not bare:
        return []
    shift = at + text.index(bare)
    if "://" in bare:
        out = []
        k = 0
        for m in re.finditer(r"[A-Za-z][\w+.-]*://\S+", bare):
            out += _word_tokens(bare[k : m.start()], shift + k, key)
            out += _url_tokens(m.group(), shift + m.start(), key)
            k = m.end()
        return out + _word_tokens(bare[k:], shift + k, key)
    if _PAIRS.match(bare):
        out = []
        for m in _PAIR.finditer(bare):
            name, value = m[1].strip(), m[2]
            out.append(Token(name, [(shift + m.start(1), shift + m.end(1))], "key", key))
            if value:
                out.append(Token(value, [(shift + m.start(2), shift + m.end(2))], "value", name))
        return out
    if not re.search(r"\s", bare):
        return [Token(bare, [(shift, shift + len(bare))], "value", key)]
    return _word_tokens(bare, shift, key)


def _word_tokens(text: str, at: int, key: str) -> list[Token]:
    """Tokens of a sentence: words; one with a colon at its end names what follows."""
    out: list[Token] = []
    name = key
    for m in re.finditer(r"\S+", text):
        word, start = m.group(), at + m.start()
        body = word.rstrip(":,;").lstrip("(")
        if word.endswith((":", "=")) and re.fullmatch(r"[\w.-]+", word[:-1]):
            name = word[:-1]
            out.append(Token(name, [(start, start + len(name))], "key", key))
            continue
        pair = re.match(r"^([\w.-]+)=(\S+)$", word)
        if pair and out and "://" not in word:
            out.append(Token(pair[1], [(start, start + len(pair[1]))], "key", key))
            s = start + pair.start(2)
            out.append(Token(pair[2], [(s, s + len(pair[2]))], "word", pair[1]))
            continue
        if body:
            s = start + word.index(body)
            if out and out[-1].text in ("-u", "--user") and ":" in body:
                user, _, secret = body.partition(":")
                out.append(Token(user, [(s, s + len(user))], "user", name))
                if secret:
                    s += len(user) + 1
                    out.append(Token(secret, [(s, s + len(secret))], "pass", name))
                continue
            out.append(Token(body, [(s, s + len(body))], "word", name))
    return out


def _joined(text: str, m: re.Match) -> Token:
    parts, spans = [], []
    for lit in _LITERAL.finditer(text, m.start(), m.end()):
        g = 1 if lit.group(1) is not None else 2
        parts.append(lit.group(g))
        spans.append(lit.span(g))
    return Token("".join(parts), spans, "value")


def line_tokens(text: str, start: int, end: int, ext: str, joined: dict[int, re.Match]) -> list[Token]:
    """Tokens of the line text[start:end]; joined literals that begin in it are taken whole."""
    line = text[start:end]
    if ext == "xml":
        out = []
        for m in _XML_NAMED.finditer(line):
            out += _content_tokens(m[2], start + m.start(2), m[1])
        for m in _XML_TEXT.finditer(line):
            out += _content_tokens(m[2], start + m.start(2), m[1])
        if "<!--" in line:
            body = line.replace("<!--", "    ").replace("-->", "   ")
            out += [t for t in _word_tokens(body, start, "") if not t.text.startswith("<")]
        return out
    if ext in ("env", "properties", "yml", "yaml", "ini", "cfg", "conf", "toml"):
        m = _CONFIG.match(line)
        if m:
            lead = Token(m["key"], [(start + m.start("key"), start + m.end("key"))], "key")
            value, at = m["value"], start + m.start("value")
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value, at = value[1:-1], at + 1
            tokens = [lead, *_content_tokens(value, at, m["key"])]
            if "#" in m["lead"]:
                for t in tokens:
                    t.marks.append("comment")
            return tokens
        bare = line.lstrip(" \t#!;-")
        return _word_tokens(bare, start + line.index(bare), "") if bare.strip() else []
    out: list[Token] = []
    key, before, comment, call_key = "", "", False, False
    at = start
    stop = end
    while at < stop:
        m = _SCAN.search(text, at, stop)
        if not m:
            break
        at = m.end()
        kind = m.lastgroup
        token = m.group()
        if kind == "com" and not comment:
            rest = text[at:stop].removesuffix("*/").removesuffix("-->")
            tokens = _word_tokens(rest, at, "") if "://" not in rest else _content_tokens(rest, at, "")
            for t in tokens:
                t.marks.append("comment")
            out += tokens
            break
        if kind == "str":
            group = joined.get(m.start())
            if group is not None:
                t = _joined(text, group)
                t.key = key
                out.append(t)
                at = group.end()
                stop = max(stop, at)
                continue
            body = token[1:-1]
            following = text[at : at + 3].lstrip(" ")
            if following[:1] == ":" and before != "?" or re.match(r"\s*=>", text[at : at + 6]):
                key = body
                out.append(Token(body, [(m.start() + 1, m.end() - 1)], "key"))
                continue
            tokens = _content_tokens(body, m.start() + 1, key)
            for t in tokens:
                t.env_key = call_key
                t.marks.append("quoted")
            if following[:1] == "," and before == "(":
                call_key = True  # the name in get(name, fallback)
            out += tokens
        elif kind == "url":
            out += _url_tokens(token, m.start(), key)
        elif kind == "op":
            if token.strip() == "||":
                call_key = True
            if "," in token and not call_key:
                key = ""
            before = token[-1]
            out.append(Token(token, [m.span()], "op", key))
            continue
        elif kind == "word":
            after = text[at : at + 3].lstrip(" ")
            if after[:1] == "=" and after[:2] != "==" or after[:1] == ":" and after[:2] != "::":
                key = token.rsplit(".", 1)[-1]
                out.append(Token(token, [m.span()], "key", key))
            else:
                out.append(Token(token, [m.span()], "word", key))
                out[-1].marks.append("code")
        before = token[-1:]
    return out


# -- features ------------------------------------------------------------------
_CUES = frozenset("bearer basic token was with is -u --user authorization apikey password login".split())


def features(tokens: list[Token], ext: str) -> list[list[str]]:
    config = ext not in ("py", "java", "js", "ts")
    out = []
    for k, t in enumerate(tokens):
        if t.kind == "op" or t.kind == "key" or t.kind == "addr" or t.kind == "user":
            out.append(["bias", f"kind={t.kind}"])
            continue
        if t.kind == "pem":
            out.append(["bias", f"pem={t.key}"])
            continue
        form = shape(t.text)
        if t.kind == "word" and "code" in t.marks:
            out.append(["bias", "kind=code", f"code={form}"])
            continue
        name = key_class(t.key)
        prev = next((p.text.lower().rstrip(":") for p in reversed(tokens[:k]) if p.kind != "op"), "")
        cue = prev if prev in _CUES else ("secretname" if key_class(prev) == "secret" else "none")
        size = "short" if len(t.text) < 8 else "long" if len(t.text) >= 16 else "mid"
        comment = "comment" in t.marks
        opened = tokens[k - 1].text.strip()[-1:] if k and tokens[k - 1].kind == "op" else tokens[k - 1].kind if k else ""
        bits = "high" if entropy(t.text) > 3.6 else "low"
        out.append(
            [
                "bias",
                f"kind={t.kind}",
                f"shape={form}",
                f"name={name}",
                f"kind+shape={t.kind},{form}",
                f"name+shape={name},{form}",
                f"cue+shape={cue},{form}",
                f"env+shape={t.env_key},{form}",
                f"size+bits={size},{bits}",
                f"comment+shape={comment},{form}",
                f"comment+kind+cue={comment},{t.kind},{cue}",
                f"config={config}",
                f"name+open+shape={name},{opened},{form}",
                f"name+kind+size={name},{t.kind},{size}" if t.kind in ("param", "pass") else f"kind+size={t.kind},{size}",
            ]
        )
    return out


# -- lines that need tokens ----------------------------------------------------
_HINTS = (
    "pass", "pwd", "secret", "token", "credential", "auth", "kennwort", "clave", "pw", "://", "akia",
    "asia", "eyj", "bearer", "basic ", "curl", "key", "contrase", "senha", "xox", "pin", "motdep", "environ", "getenv", "getprop", "process.env",
)
_LINE_HINT = re.compile(
    r"[Pp]assw|[Pp]assphr|[Pp]asscode|(?<![a-z])pass(?![a-z])|Pass(?![a-z])|pwd|[Pp]w(?![a-z])|(?<![A-Za-z])PW|PASS|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN"
    r"|[Cc]redential|CREDENTIAL|[Aa]uth|AUTH|[Kk]ennwort|KENNWORT|(?<![a-z])[Cc]lave(?![a-z])|CLAVE|[Kk]ey(?![a-z])|KEY"
    r"|://[^/\s\"']*@|[?&][\w.-]+=[\w%+/.~-]{12,}|-u\s+\S+:|[Bb]earer\s|[Bb]asic\s|[Cc]ontrase|[Ss]enha|(?<![A-Za-z])[Pp]in(?![a-z])|Pin(?![a-z])|PIN|[Mm]ot_?[Dd]e_?[Pp]asse"
    r"|(?:environ\.get|getenv|getProperty)\([^,()]*,|process\.env[\w.\[\]\"']*\s*(?:\|\||\?\?)"
)
_LONG = re.compile(r"(?<![\w+/-])(?=[\w+/-]*\d)[A-Za-z][\w+/-]{19,}")


def joined_literals(text: str, ext: str) -> dict[int, re.Match]:
    """Neighbouring literals of a program, by where the first begins."""
    if ext not in ("py", "java", "js", "ts"):
        return {}
    return {m.start(): m for m in _JOINED.finditer(text)}


def candidate_lines(text: str, starts: list[int], joined: dict[int, re.Match]) -> list[int]:
    """Numbers (from 0) of lines with a hint of a credential, or with a token that looks like one by itself."""
    low = text.lower()
    found: set[int] = set()
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            line = bisect_right(starts, at) - 1
            found.add(line)
            at = low.find(hint, starts[line + 1] if line + 1 < len(starts) else len(low))
    keep = {k for k in found if _LINE_HINT.search(text, starts[k], starts[k + 1] if k + 1 < len(starts) else len(text))}
    for m in _LONG.finditer(text):
        token = m.group()
        if _TYPED.match(token) or token.startswith("eyJ"):
            keep.add(bisect_right(starts, m.start()) - 1)
    if "AKIA" in text or "ASIA" in text:
        keep |= {bisect_right(starts, m.start()) - 1 for m in re.finditer(r"A(?:KI|SI)A[0-9A-Z]{16}", text)}
    for at, m in joined.items():
        if shape(_joined(text, m).text) in ("typed", "jwt"):
            keep.add(bisect_right(starts, at) - 1)
    return sorted(keep)


def pem_tokens(text: str) -> list[Token]:
    """Keys and certificates in PEM form; the body may be split over joined literals."""
    out = []
    for m in PEM.finditer(text):
        end = _PEM_END.search(text, m.end())
        nxt = PEM.search(text, m.end())
        if end and not (nxt and nxt.start() < end.start()):
            close = end.start()
        else:  # an open mark claims the lines of the body that follow directly
            close = _PEM_LINES.match(text, m.end()).end()
        spans = [x.span() for x in _PEM_BODY.finditer(text, m.end(), close)]
        if sum(b - a for a, b in spans) < 60:
            continue
        kind = "private" if "PRIVATE KEY" in m["type"] else "public"
        out.append(Token(text[m.start() : m.end()], [m.span(), *spans], "pem", kind))
    return out
