"""Statistics of texts that tell natural prose from lists, tables and junk.

Most counts are sums over characters, words and lines, so partial counts of the
chunks of a text add up in any grouping. A huge text is cut at line ends; a line
that is longer than a chunk is cut behind white space, or, in a run without any,
behind a character that no word continues over. What crosses such a cut is bounded:
each piece starts from the state that the cutter saw (inside a token, inside a
word), and becomes counters, the counters of its first and last sentence, which
the neighbours complete, and the beginning of the line. Adding two pieces closes
the sentences between them; the addition is associative, and its result doesn't
grow with the text. A text of up to ``chunk_chars`` characters is one chunk and is
finished where it is read.

Defined results for odd input
-----------------------------
* Null, empty and blank texts have all counts 0, ratios null and the class
  ``blank``. Null ids are dropped.
* Repeated rows of one id give one row. Of rows of one id with different texts the
  one with the greatest text counts.
* Lines of any length are counted whole; whether one is a bullet, a pair or begins
  with a speaker shows in its first ``HEAD`` characters. Other columns are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: How much of a long line is kept to tell what kind of line it is.
HEAD = 256
#: Frequent words of English, German and Spanish that carry no topic.
COMMON = frozenset(
    "a about after all an and any are as at be because been before but by can could does down each for from had has have "
    "he her how i if in into is it its just many more most much no not of off on once one only or other our out over own "
    "she should so some such than that the their them then there these they this to twice two under until up was we were "
    "what when where which while who why will with without would you your "
    "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einen einer eines er es für gibt "
    "hat ihn ihr im in ist kann mehr mit muss nach nicht noch nur ob oder sein sich sie sind so soll über um und uns unter "
    "vom von vor war wenn wer werden wie wir wird zu zum zur zwischen dann selbst wenige haben "
    "al ante aunque bajo cada como con cuando cuyo de del desde donde el ella en entre era es esta este fue ha hasta hay la "
    "las lo los más muy nada ni nos o para pero por porque que se según ser si sin sobre son su sus también un una "
    "uno ya además cualquier".split()
)
#: Frequent Chinese particles.
HAN_COMMON = frozenset("的了在是和并就不会从这那个有对于把被与及而或其为之时到先再都上后")
_COUNTS = (
    "chars words letters word_chars common symbols digits spaces lines ended bullets pairs tables prose_chars solid_chars han tokens"
).split()
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_BULLET = re.compile(r"(?:[-*•·–+]|\[[ x]?\]|\(?\d{1,4}[.)]|[a-z][.)])\s+\S")
_KEY = re.compile(r"[\w./-]{1,200}\s*[:=]\s*(?=\S)")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[t ]\d\d:\d\d")
_RULE = re.compile(r"-{3,}(?:[|+]-{3,})+$")
_SPEAKER = re.compile(r"[\w .-]{1,30}:\s+(?=\S+\s+\S+\s+\S)")
_SENTENCE = re.compile(r"(?<=[.!?。！？;；])\s+|(?<=[。！？；])")
_STOPS = (".", "!", "?", '."', ".)")
_ENDS = tuple(".!?:;。！？：；…\"'”’)")
_is_common = COMMON.__contains__


def sentence(part: str, mid_token: bool = False, mid_word: bool = False) -> list:
    """[words, common words, han, common han, letters of words, solid characters, tokens, apostrophes, last two characters].

    ``part`` is in lower case. The flags tell that it continues a token or word, which was counted where it began.
    """
    ws = _WORD.findall(part)
    tokens = part.split()
    joined = "".join(ws)
    n, common = len(ws), sum(map(_is_common, ws))
    if mid_word and ws and part.startswith(ws[0]):
        n, common = n - 1, common - (ws[0] in COMMON)
    han = marks = 0
    if not part.isascii():
        found = _HAN.findall(part)
        han, marks = len(found), sum(c in HAN_COMMON for c in found)
    marks_in_words = joined.count("'") + joined.count("’") if "'" in part or "’" in part else 0
    inside = mid_token and part[:1].strip() != ""
    tail = tokens[-1][-2:] if tokens else ""
    return [n, common, han, marks, len(joined), sum(map(len, tokens)), len(tokens) - inside, marks_in_words, tail]


def natural(s: list) -> bool:
    """Whether a sentence or line is natural language."""
    n, common, han, marks, letters, solid, tokens, _, tail = s
    if han:
        return han >= 4 and marks * 12 >= han
    told = common >= 2 and common * (5 if n < 10 else 9) >= n or common >= 1 and n >= 4 and tail.endswith(_STOPS)
    # encoded bytes have words by chance, but hardly a space
    return told and letters * 10 >= solid * 6 and solid <= 14 * max(tokens, 1)


def _sum(a: list, b: list, glued: bool = False) -> list:
    tail = (a[8] + b[8])[-2:] if glued and b[5] == 1 else b[8] or a[8]
    return [x + y for x, y in zip(a[:8], b[:8])] + [tail]


def _tail(text: str) -> str:
    """The last two characters of the last token."""
    text = text.rstrip()
    return text[-2:] if not text[-2:-1].isspace() else text[-1:]


def _split(body: str) -> list[str]:
    parts = _SENTENCE.split(body)
    return parts if len(parts) == 1 else [p for p in parts if p]


def _digits(text: str) -> int:
    return sum(map(text.count, "0123456789")) if text.isascii() else len(_DIGIT.findall(text))


_DIGIT = re.compile(r"\d")


def _is_pair(head: str, tokens: int) -> bool:
    if _STAMP.match(head):
        return True
    m = _KEY.match(head)
    if not m:
        return False
    before = m.group()
    return tokens == len(before.split()) + before[-1].isspace()


def count_lines(text: str) -> list[int]:
    """The counts of a run of whole lines, in the order of _COUNTS."""
    if "\r" in text:
        text = re.sub(r"\r+(?=\n|$)", "", text)
    words = letters = common = marks = lines = ended = bullets = pairs = tables = prose = han = 0
    tokens = solid = 0
    for line in text.lower().split("\n"):
        bare = line.strip()
        if not bare:
            continue
        lines += 1
        ended += bare.endswith(_ENDS)
        bullets += _BULLET.match(bare) is not None
        tables += bare.count(";") + bare.count("|") + bare.count("\t") >= 2 or bare[0] == "-" and _RULE.match(bare) is not None
        body, total = bare, None
        if ":" in bare[:40]:
            speaker = _SPEAKER.match(bare)
            if speaker:
                total = sentence(speaker.group())
                body = bare[speaker.end() :]
        parts = _split(body)
        if len(parts) == 1:
            own = sentence(parts[0])
            kept = own[5] if natural(own) else 0
            whole = bool(kept)
        else:
            own, kept = None, 0
            for part in parts:
                s = sentence(part)
                if natural(s):
                    kept += s[5]
                own = s if own is None else _sum(own, s)
            own[8] = _tail(body)
            whole = kept and natural(own)
        total = own if total is None else _sum(total, own)
        words += total[0]
        common += total[1]
        han += total[2]
        letters += total[4]
        solid += total[5]
        tokens += total[6]
        marks += total[7]
        prose += total[5] if whole else kept  # short sentences of a natural line belong to it
        if ":" in bare or "=" in bare or bare[0].isdigit():
            pairs += _is_pair(bare, total[6])
    digits = _digits(text)
    chars = len(text) - text.count("\n")
    plain = letters - marks
    return [chars, words, plain, letters, common, solid - plain - digits, digits, chars - solid, lines, ended, bullets, pairs, tables, prose, solid, han, tokens]


# -- pieces of a long line -----------------------------------------------------
def piece(part: str, fresh: bool = True, mid_token: bool = False, mid_word: bool = False) -> dict:
    """The summary of a piece of a line; ``fresh`` if the line begins with it."""
    low = part.lower()
    body, spoken = low, None
    if fresh:
        body = low.lstrip()
        m = _SPEAKER.match(body)
        if m:
            spoken, body = sentence(m.group()), body[m.end() :]
    parts = _SENTENCE.split(body)
    s = [sentence(p, mid_token and k == 0, mid_word and k == 0) for k, p in enumerate(parts)]
    own = [*reduce(_sum, s)[:8], _tail(body)]
    return {
        "chars": len(part), "digits": _digits(part), "seps": low.count(";") + low.count("|") + low.count("\t"),
        "ruled": not low.strip(" -|+"), "head": low.lstrip()[:HEAD] if fresh else "", "glued": mid_token, "spoken": spoken, "first": s[0],
        "last": s[-1] if len(s) > 1 else None, "kept": sum(x[5] for x in s[1:-1] if natural(x)),
        "own": own,
    }


def add(a: dict, b: dict) -> dict:
    """The summary of two neighbouring pieces; associative."""
    out = {k: a[k] + b[k] for k in ("chars", "digits", "seps", "kept")}
    out |= {"ruled": a["ruled"] and b["ruled"], "head": a["head"], "glued": a["glued"], "spoken": a["spoken"], "own": _sum(a["own"], b["own"], b["glued"])}
    middle = _sum(a["last"] or a["first"], b["first"], b["glued"])
    if a["last"] is None:
        out["first"], out["last"] = middle, b["last"]
    elif b["last"] is None:
        out["first"], out["last"] = a["first"], middle
    else:
        out["first"], out["last"] = a["first"], b["last"]
        out["kept"] += middle[5] if natural(middle) else 0
    return out


def close(p: dict) -> list[int]:
    """The counts of a whole line."""
    own = p["own"]
    total = own if p["spoken"] is None else _sum(p["spoken"], own)
    kept = p["kept"] + sum(x[5] for x in (p["first"], p["last"]) if x is not None and natural(x))
    n, common, han, _, letters, solid, tokens, marks, tail = total
    if not solid:
        return [p["chars"], 0, 0, 0, 0, 0, 0, p["chars"], *[0] * 9]
    plain, head = letters - marks, p["head"]
    rule = p["ruled"] and head.startswith("---") and "+" in head
    return [
        p["chars"], n, plain, letters, common, solid - plain - p["digits"], p["digits"], p["chars"] - solid, 1, int(tail.endswith(_ENDS)),
        int(_BULLET.match(head) is not None), int(_is_pair(head, tokens)), int(p["seps"] >= 2 or rule),
        solid if kept and natural(own) else kept, solid, han, tokens,
    ]


def chunks(text: str, size: int) -> Iterator[tuple[int, bool, bool, bool, str]]:
    """(line, fresh, inside a token, inside a word, part): runs of whole lines with line -1, and the pieces of longer lines."""
    size = max(size, HEAD + 64)
    at, line, n = 0, 0, len(text)
    while at < n:
        end = text.rfind("\n", at, at + size)
        if end >= 0 or n - at <= size:  # whole lines
            end = end if end >= 0 and n - at > size else n
            yield -1, True, False, False, text[at:end]
            at = end + 1
            continue
        stop = text.find("\n", at + size)
        stop = n if stop < 0 else stop
        fresh, token, word, line = True, False, False, line + 1
        while at < stop:
            cut = min(at + size, stop)
            token_next = word_next = False
            if cut < stop:
                back = cut
                while back > at + size // 2 and not text[back - 1].isspace():
                    back -= 1
                if back > at + size // 2:
                    cut = back
                else:
                    back = cut
                    while back > at + size // 2 and (text[back - 1].isalpha() or text[back - 1] in "'’"):
                        back -= 1
                    cut = back if back > at + size // 2 else cut
                    if text[cut].isspace():  # a sentence may end here
                        cut += 1
                    else:
                        token_next = True
                        word_next = text[cut - 1].isalpha() and text[cut].isalpha()
            yield line, fresh, token, word, text[at:cut].rstrip("\r") if cut == stop else text[at:cut]
            at, fresh, token, word = cut, False, token_next, word_next
        at = stop + 1


_SCHEMA = "doc_id long, " + ", ".join(f"n_{c} long" for c in _COUNTS)


def _small(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [count_lines(t) for t in batch.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [[] for _ in _COUNTS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *(f"n_{c}" for c in _COUNTS)]
        )


def _chunked(size: int):
    names = ["doc_id", "seq", "line", "fresh", "token", "word", "part"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(doc, k, *row) for k, row in enumerate(chunks(text, size))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _partials(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        doc, seq, line, fresh, token, word, part = (c.to_pylist() for c in batch.columns)
        counts = [count_lines(t) if x < 0 else None for x, t in zip(line, part)]
        states = [None if x < 0 else json.dumps(piece(t, f, m, w)) for x, f, m, w, t in zip(line, fresh, token, word, part)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.list_(pa.int64())), pa.array(states, pa.string())],
            names=["doc_id", "seq", "line", "counts", "state"],
        )


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of one long line from its pieces."""
    states = [json.loads(x) for x in pdf.sort_values("seq")["state"]]
    while len(states) > 1:  # a tree: neighbours first
        states = [add(*states[k : k + 2]) if k + 1 < len(states) else states[k] for k in range(0, len(states), 2)]
    return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "counts": [close(states[0])]})


def _large(rows: DataFrame, size: int) -> DataFrame:
    parts = rows.mapInArrow(_chunked(size), "doc_id long, seq int, line int, fresh boolean, token boolean, word boolean, part string")
    partial = parts.repartition("doc_id", "seq").mapInArrow(
        _partials, "doc_id long, seq int, line int, counts array<long>, state string"
    )
    partial = cut_lineage(partial)
    lines = partial.where("line >= 0").groupBy("doc_id", "line").applyInPandas(_merge, "doc_id long, counts array<long>")
    every = partial.where("line < 0").select("doc_id", "counts").unionByName(lines)
    return every.groupBy("doc_id").agg(*(F.sum(F.col("counts")[k]).alias(f"n_{c}") for k, c in enumerate(_COUNTS)))


def text_statistics(
    texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1_000_000, prose_share: float = 0.25
) -> DataFrame:
    """One row per text: counts, ratios, and the class prose, list, table, junk or blank."""
    rows = (
        texts.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"))
    )
    long = F.char_length("text") > chunk_chars
    counts = rows.where(~long).mapInArrow(_small, _SCHEMA).unionByName(_large(rows.where(long), chunk_chars))
    solid = F.nullif("n_solid_chars", F.lit(0))
    lines = F.nullif("n_lines", F.lit(0))

    def ratio(a: str, b) -> F.Column:
        return F.round(F.col(a) / b, 6)

    stats = counts.select(
        "doc_id",
        F.col("n_chars"),
        F.col("n_words"),
        F.col("n_lines"),
        ratio("n_word_chars", F.nullif("n_words", F.lit(0))).alias("mean_word_length"),
        ratio("n_solid_chars", F.nullif("n_tokens", F.lit(0))).alias("mean_token_length"),
        ratio("n_symbols", solid).alias("symbol_ratio"),
        ratio("n_digits", solid).alias("digit_ratio"),
        ratio("n_common", F.nullif("n_words", F.lit(0))).alias("common_word_share"),
        ratio("n_ended", lines).alias("ended_line_share"),
        ratio("n_bullets", lines).alias("bullet_line_share"),
        ratio("n_pairs", lines).alias("pair_line_share"),
        ratio("n_tables", lines).alias("table_line_share"),
        ratio("n_prose_chars", solid).alias("prose_share"),
    )
    kind = (
        F.when(F.col("prose_share").isNull(), "blank")
        .when(F.col("prose_share") >= prose_share, "prose")
        .when((F.col("table_line_share") + F.col("pair_line_share")) > 0.5, "table")
        .when((F.col("symbol_ratio") + F.col("digit_ratio") > 0.35) | (F.col("mean_token_length") > 20), "junk")
        .otherwise("list")
    )
    return stats.withColumn("quality", kind)
