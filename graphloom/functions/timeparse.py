"""Time expressions in texts: explicit dates, months, quarters, years and relative spans, as half-open ranges of days."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTHS = {m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_NUMBERS = {w: k for k, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
_MONTH = "|".join(_MONTHS)
_PATTERNS = [
    ("iso", re.compile(r"\b((?:19|20)\d\d)-(\d{1,2})-(\d{1,2})\b")),
    ("cjk", re.compile(r"((?:19|20)\d\d)年(\d{1,2})月(?:(\d{1,2})日)?")),
    ("day", re.compile(rf"\b({_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)\b")),
    ("month", re.compile(rf"\b(?:in\s+)?({_MONTH})\s+((?:19|20)\d\d)\b")),
    ("quarter", re.compile(r"\bq([1-4])\s+((?:19|20)\d\d)\b")),
    ("ago", re.compile(r"\b(\d{1,3}|%s)\s+(day|week|month|year)s?\s+ago\b" % "|".join(_NUMBERS))),
    ("last", re.compile(r"\b(last|this)\s+(week|month|quarter|year)\b")),
    ("named", re.compile(r"\b(today|yesterday)\b|(今天|昨天)")),
    ("year", re.compile(r"\b(?:in|during|since)\s+((?:19|20)\d\d)\b")),
]


def _month(y: int, m: int) -> tuple[date, date]:
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return date(y, m, 1), date(y + m // 12, m % 12 + 1, 1)


def _span(kind: str, m: re.Match, today: date) -> tuple[date, date, float] | None:
    try:
        if kind in ("iso", "cjk"):
            if m[3] is None:
                return (*_month(int(m[1]), int(m[2])), 0.8) if 1 <= int(m[2]) <= 12 else None
            d = date(int(m[1]), int(m[2]), int(m[3]))
            return d, d + timedelta(1), 0.9
        if kind == "day":
            d = date(int(m[3]), _MONTHS[m[1]], int(m[2]))
            return d, d + timedelta(1), 0.9
        if kind == "month":
            return (*_month(int(m[2]), _MONTHS[m[1]]), 0.8)
        if kind == "quarter":
            first = 3 * int(m[1]) - 2
            return _month(int(m[2]), first)[0], _month(int(m[2]), first + 2)[1], 0.8
        if kind == "year":
            return date(int(m[1]), 1, 1), date(int(m[1]) + 1, 1, 1), 0.75
        if kind == "named":
            d = today - timedelta((m[1] or "") == "yesterday" or m[2] == "昨天")
            return d, d + timedelta(1), 0.9
        if kind == "last":
            back = m[1] == "last"
            if m[2] == "week":
                d = today - timedelta(today.weekday() + 7 * back)
                return d, d + timedelta(7), 0.85
            if m[2] == "month":
                return (*_month(today.year, today.month - back), 0.8)
            if m[2] == "quarter":
                first = (today.month - 1) // 3 * 3 + 1 - 3 * back
                return _month(today.year, first)[0], _month(today.year, first + 2)[1], 0.8
            return date(today.year - back, 1, 1), date(today.year - back + 1, 1, 1), 0.75
        n = _NUMBERS.get(m[1]) or int(m[1])
        if n > 100:
            return None
        if m[2] == "day":
            d = today - timedelta(n)
            return d, d + timedelta(1), 0.85 if n <= 7 else 0.7
        if m[2] == "week":
            d = today - timedelta(today.weekday() + 7 * n)
            return d, d + timedelta(7), 0.75
        if m[2] == "month":
            mid = today - timedelta(30 * n)
            return mid - timedelta(15), mid + timedelta(15), 0.65
        return date(today.year - n, 1, 1), date(today.year - n + 1, 1, 1), 0.6
    except ValueError:
        return None


def parse(text: str, now_ms: int) -> tuple[int, int, float, str] | None:
    """(start_ms, end_ms, confidence, text without the expressions): the hull of all, with the highest confidence."""
    today = datetime.fromtimestamp(now_ms / 1000, UTC).date()
    rest, spans = text.lower(), []
    for kind, pattern in _PATTERNS:  # earlier kinds block later ones that overlap
        for m in pattern.finditer(rest):
            s = _span(kind, m, today)
            if s:
                spans.append(s)
                rest = rest[: m.start()] + "\0" * (m.end() - m.start()) + rest[m.end() :]
    if not spans:
        return None
    ms = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp() * 1000)
    kept = "".join(a for a, b in zip(text, rest) if b != "\0") if len(rest) == len(text) else rest.replace("\0", "")
    return ms(min(s[0] for s in spans)), ms(max(s[1] for s in spans)), max(s[2] for s in spans), re.sub(r"\s+", " ", kept).strip()


def mentioned_times(rows: DataFrame, *, id_col: str, text_col: str, now_ms: int) -> DataFrame:
    """(id, start_ms, end_ms, confidence, rest) of the texts that mention a time; null texts mention none."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and (p := parse(t, now_ms))]
            cols = list(zip(*out)) if out else [()] * 5
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "start_ms", "end_ms", "confidence", "rest"])

    return rows.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, start_ms long, end_ms long, confidence double, rest string")
