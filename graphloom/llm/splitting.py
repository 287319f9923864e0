"""Cutting oversized texts at natural boundaries by structure-tree packing.

A text longer than its limit is read as a tree: for documents pages, headings (marked
by # or underlined), blocks of markup, paragraphs, list items, sentences and words; for code blocks by indentation,
then statements within a line. Starting at the leaves, neighbouring subtrees are
merged as long as they fit; only a subtree that is larger than the limit is
opened. A run of characters without any boundary is cut hard as a last resort.

Every piece but the first begins with the last ``overlap_chars`` characters of
the text before its own part, and no piece is longer than ``max_chars``. Leaving
these beginnings out, the pieces joined in order give the text back.

Only texts over the limit leave the JVM; each is handled on its own, so no
grouping and no shuffle is needed.

Defined results for odd input
-----------------------------
* Null texts and texts within the limit have no pieces; so have rows whose kind
  has no limit. Lengths count Unicode code points.
* An overlap as large as the limit is lowered to the limit less one.
* A limit that is null or below one cuts nothing. Of several limits of one kind
  the smallest counts, then the largest overlap.
* There may be limits for ``MOST_KINDS`` kinds; more are an error.
* Rows that are repeated give repeated pieces; callers that know the key of a
  record take distinct rows.
* Other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
MOST_KINDS = 10_000

_PAGE = re.compile(r"\f")
_HEADING = re.compile(r"^(#{1,6})[ \t]+\S", re.M)
_UNDERLINED = re.compile(r"^[^\s#>|+*-][^\n]*\n(={3,}|-{3,})[ \t]*\r?$", re.M)
_TAGGED = re.compile(r"<(?:h[1-6]|section|article|div|p|ul|ol|li|table|tr|pre|blockquote)\b[^<>]*>", re.I)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_ITEM = re.compile(r"\n(?=[ \t]*(?:[-*•+]|\d{1,4}[.)])[ \t]+\S)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？；])")
_SPACE = re.compile(r"\s+")
_STATEMENT = re.compile(r"[;}](?![;}])")
_COMMA = re.compile(r",\s*|\s+|>(?=<)")
_BLOCK_TAIL = re.compile(r"[ \t]*(?:[)\]}]|</|(?:else|elif|except|finally|catch|end)\b)")
_LEAD = re.compile(r"[ \t]*(?:@\w|//|#|/\*|\*|--|<!--)")


def _ends(pattern: re.Pattern) -> Callable[[str, int, int], list[int]]:
    """Cuts after each match of the pattern."""
    return lambda text, start, end: [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]


def _heading_cuts(level: int) -> Callable[[str, int, int], list[int]]:
    mark = "=-"[level - 1 : level]

    def cuts(text: str, start: int, end: int) -> list[int]:
        found = {m.start() for m in _HEADING.finditer(text, start, end) if len(m.group(1)) == level and m.start() > start}
        if mark and mark * 3 in text:
            found |= {m.start() for m in _UNDERLINED.finditer(text, start, end) if m.group(1)[0] == mark and m.start() > start}
        return sorted(found)

    return cuts


def _tag_cuts(text: str, start: int, end: int) -> list[int]:
    """Cuts before tags that open a block."""
    return [m.start() for m in _TAGGED.finditer(text, start, end) if m.start() > start]


DOCUMENT_CUTS = [
    _ends(_PAGE),
    *(_heading_cuts(level) for level in range(1, 7)),
    _tag_cuts,
    _ends(_PARAGRAPH),
    _ends(_ITEM),
    _ends(_SENTENCE),
    _ends(_SPACE),
]
LINE_CUTS = [_ends(_STATEMENT), _ends(_COMMA)]


def pack(spans: list[Span], limit: int) -> list[Span]:
    """Merge neighbours, in order, as long as they fit."""
    out: list[Span] = []
    for start, end in spans:
        if out and end - out[-1][0] <= limit:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _parts(start: int, end: int, cuts: list[int]) -> list[Span]:
    edges = [start, *cuts, end]
    return list(zip(edges, edges[1:]))


def split_by(text: str, start: int, end: int, limit: int, cutters: list) -> list[Span]:
    """Spans of at most ``limit`` characters, opened cutter by cutter."""
    if end - start <= limit:
        return [(start, end)]
    for depth, cutter in enumerate(cutters):
        cuts = cutter(text, start, end)
        if cuts:
            spans: list[Span] = []
            for a, b in _parts(start, end, cuts):
                spans += split_by(text, a, b, limit, cutters[depth + 1 :])
            return pack(spans, limit)
    return [(a, min(a + limit, end)) for a in range(start, end, limit)]


class _Lines:
    """Line starts and indentations of a source text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0]
        self.indents: list[int] = []
        at = 0
        for line in text.split("\n"):
            bare = line.lstrip(" \t")
            self.indents.append(-1 if not bare or bare == "\r" else len(line[: len(line) - len(bare)].expandtabs(8)))
            at += len(line) + 1
            self.starts.append(at)
        self.starts[-1] = len(text)

    def children(self, first: int, last: int) -> list[tuple[int, int]]:
        """The blocks that lines first..last-1 consist of, as ranges of lines."""
        used = [i for i in self.indents[first:last] if i >= 0]
        if not used:
            return []
        low = min(used)
        heads: list[int] = []
        leading = False
        for k in range(first, last):
            if self.indents[k] != low:
                continue
            line_start = self.starts[k]
            if heads and _BLOCK_TAIL.match(self.text, line_start):
                leading = False
                continue
            if not leading:
                heads.append(k)
            leading = bool(_LEAD.match(self.text, line_start))
        if not heads:
            return []
        heads[0] = first
        if len(heads) > 1:
            return list(zip(heads, [*heads[1:], last]))
        # one block: its head and tail lines are leaves around its body
        body = [k for k in range(first, last) if self.indents[k] > low]
        if not body:
            return [(k, k + 1) for k in range(first, last)] if last - first > 1 else []
        cut = sorted({first, body[0], body[-1] + 1, last})
        ranges = list(zip(cut, cut[1:]))
        return ranges if len(ranges) > 1 else []


def split_code(text: str, limit: int) -> list[Span]:
    lines = _Lines(text)

    def visit(first: int, last: int) -> list[Span]:
        start, end = lines.starts[first], lines.starts[last]
        if end - start <= limit:
            return [(start, end)] if end > start else []
        if last - first == 1:
            return split_by(text, start, end, limit, LINE_CUTS)
        blocks = lines.children(first, last) or [(k, k + 1) for k in range(first, last)]
        spans: list[Span] = []
        for a, b in blocks:
            spans += visit(a, b)
        return pack(spans, limit)

    return visit(0, len(lines.indents))


def split_document(text: str, limit: int) -> list[Span]:
    return split_by(text, 0, len(text), limit, DOCUMENT_CUTS)


def pieces(text: str, kind: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """(start, own_start, end) of each piece; the overlap lies from start to own_start."""
    overlap = max(0, min(overlap_chars, max_chars - 1))
    spans = (split_code if kind == "code" else split_document)(text, max_chars - overlap)
    return [(max(0, a - overlap) if k else a, a, b) for k, (a, b) in enumerate(spans)]


def split_items(
    items: DataFrame,
    limits: DataFrame,
    *,
    kind: Column,
    item_id: Column,
    text: Column,
    with_text: bool = True,
) -> DataFrame:
    """(item_kind, item_id, piece_no, start, own_start, end[, piece]) of every item over its limit.

    ``limits`` has item_kind, max_chars and overlap_chars: one row for each kind. They
    become literals of the plan, so nothing is joined; their number is checked.
    """
    bounds = (
        limits.where("item_kind is not null and max_chars >= 1")
        .groupBy(F.col("item_kind").alias("lim_kind"))
        .agg(F.min(F.struct("max_chars", -F.coalesce("overlap_chars", F.lit(0)))).alias("b"))
        .select("lim_kind", F.col("b.max_chars").alias("lim_max"), (-F.col("b.col2")).alias("lim_overlap"))
    )
    known = bounds.limit(MOST_KINDS + 1).collect()
    if len(known) > MOST_KINDS:
        raise ValueError(f"limits of more than {MOST_KINDS} kinds")
    given = items.select(kind.alias("item_kind"), item_id.cast("long").alias("item_id"), text.alias("text"))
    limit = F.map_from_arrays(F.array(*[F.lit(b["lim_kind"]) for b in known]), F.array(*[F.lit(b["lim_max"]) for b in known])) if known else None
    extra = F.map_from_arrays(F.array(*[F.lit(b["lim_kind"]) for b in known]), F.array(*[F.lit(b["lim_overlap"]) for b in known])) if known else None
    none = F.lit(None).cast("int")
    over = given.withColumns(
        {"lim_max": F.try_element_at(limit, F.col("item_kind")) if known else none, "lim_overlap": F.try_element_at(extra, F.col("item_kind")) if known else none}
    ).where(F.char_length("text") > F.col("lim_max"))
    schema = "item_kind string, item_id long, piece_no int, start int, own_start int, end int"
    if with_text:
        schema += ", piece string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7 if with_text else 6)]
            for kind_, id_, text_, most, overlap in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for no, (start, own, end) in enumerate(pieces(text_, kind_, most, overlap)):
                    row = (kind_, id_, no, start, own, end, text_[start:end] if with_text else None)
                    for col, value in zip(cols, row):
                        col.append(value)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = ["item_kind", "item_id", "piece_no", "start", "own_start", "end", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names[: len(cols)])

    return over.select("item_kind", "item_id", "text", "lim_max", "lim_overlap").mapInArrow(cut, schema)
