"""Test items that lie in corpus texts, wholly or for the most part.

Texts and items are reduced to words: case, punctuation, markup, entities,
invisible characters, accents and hyphens at line ends don't count; scripts that
are written without spaces give a word for each character. A Wu-Manber search
over words finds where pairs of neighbouring words of an item occur: the shift
table, keyed by words, skips places that no pair can end at; where it gives no
shift, the bucket of the word holds the pairs to compare. Around the places found
the item is then compared directly: the longest common subsequence of its words
with the words of the neighbourhood must reach ``share`` of them. A closing
instruction that several items carry belongs to none of them.

Which pairs are searched for: if ``share`` of an item's n words are kept, at least
(2 share - 1) n - 1 of its pairs are whole, less one for each inserted word; with
room for 1 + n / 8 inserted words, so many of its most frequent pairs (by items that
hold them) need no place in the tables, and every occurrence still meets one of
the rest. Items too short for that are found by their rarest single words, of
which an occurrence must hold one.

Items are cleaned where they lie and different ones are sent to the workers in
blocks of ``block_words`` words in all (a longer item is a block of its own), so the
broadcast tables are bounded however many items there are. Each block is one pass
over the texts; its machine is built once per worker; no text is shuffled. The
driver holds one block at a time.

Defined results for odd input
-----------------------------
* Null, empty and blank texts and items match nothing; nor do items without a
  letter or digit. Null ids are dropped; of several texts of an item the greatest counts.
* An item that occurs several times in a text gives one row, as do repeated rows.
* Equal items under several ids give a row for each id.
* Texts of any length are searched whole. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

# Han, kana, Thai, Lao, Burmese and Khmer letters are words by themselves
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_ANY_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+(?:_+[^\W_{_UNSPACED}]+)*")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|mark|sup|sub|font|small|tt|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[ \t]*(?:[*#>|/]+[ \t]+)?(?=[^\W\d_])")
_UNSEEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿̀-ͯ]")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


def words(text: str | None) -> list[str]:
    """The words of a text as the search sees them."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    if "-" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    return (_WORD if text.isascii() else _ANY_WORD).findall(text.lower())


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence."""
    return [words(p) for p in _SENTENCE_END.split(text.strip()) if p]


class WuManber:
    """Pairs of words of many items, searched at once."""

    def __init__(self, items: dict[int, list[str]], share: float = 0.6) -> None:
        self.items = {i: ws for i, ws in items.items() if ws}
        self.share = share
        pair_items = Counter(p for ws in self.items.values() for p in set(zip(ws, ws[1:])))
        word_items = Counter(w for ws in self.items.values() for w in set(ws))
        #: by the last word of a pair: the word before it, then where the pair lies in which item
        self.buckets: dict[str, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        #: by a word: the items that are found by single words, and where it lies in them
        self.single: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.shift: dict[str, int] = {}
        self.need: dict[int, int] = {}
        for item, ws in self.items.items():
            n = len(ws)
            need = self.need[item] = max(1, ceil(share * n - 1e-9))
            spare = 2 * need - n - 1 - (1 + n // 8) - 1  # whole pairs of an occurrence, but one
            if spare >= 0:
                places = sorted(range(n - 1), key=lambda k: (-pair_items[(ws[k], ws[k + 1])], k))
                for k in places[spare:]:
                    self.buckets[ws[k + 1]][ws[k]].append((item, k))
            else:
                for k in sorted(range(n), key=lambda k: (-word_items[ws[k]], k))[need - 1 :]:
                    self.single[ws[k]].append((item, k))
        for last, firsts in self.buckets.items():
            self.shift[last] = 0
            for first in firsts:
                self.shift.setdefault(first, 1)
        self.buckets = {a: dict(b) for a, b in self.buckets.items()}
        self.single = dict(self.single)
        self.sets = {i: frozenset(ws) for i, ws in self.items.items()}
        self.masks: dict[int, dict[str, int]] = {}

    def places(self, text: list[str]) -> dict[int, list[int]]:
        """For each item where in the text it would begin, by the pairs and words found."""
        found: dict[int, list[int]] = defaultdict(list)
        if self.buckets:
            shift, buckets = self.shift.get, self.buckets
            n, at = len(text), 1
            while at < n:
                step = shift(text[at], 2)
                if step:
                    at += step
                    continue
                hits = buckets[text[at]].get(text[at - 1])
                if hits:
                    for item, k in hits:
                        found[item].append(at - 1 - k)
                at += 1
        if self.single and not self.single.keys().isdisjoint(text):
            for at, w in enumerate(text):
                for item, k in self.single.get(w, ()):
                    found[item].append(at - k)
        return found

    def common(self, item: int, window: list[str]) -> int:
        """The length of the longest common subsequence with the item, by bits."""
        mask = self.masks.get(item)
        if mask is None:
            mask = {}
            for k, w in enumerate(self.items[item]):
                mask[w] = mask.get(w, 0) | 1 << k
            self.masks[item] = mask
        n = len(self.items[item])
        full = (1 << n) - 1
        row = full
        for w in window:
            m = mask.get(w)
            if m:
                u = row & m
                row = (row + u | row - u) & full
        return n - row.bit_count()

    def coverage(self, text: list[str], item: int, begins: list[int]) -> float:
        """The largest share of the item's words that lies in one neighbourhood of the text, in order; 0 if too small."""
        n, different = len(self.items[item]), self.sets[item]
        # an occurrence lacks at most n - need words, so at least so many different ones are there
        least = len(different) - (n - self.need[item])
        slack = max(4, n // 3)
        best, last = 0, None
        for begin in sorted(begins):
            if last is not None and begin - last < max(1, n // 8):
                continue
            last = begin
            window = text[max(0, begin - slack // 2 - n // 8) : begin + n + slack]
            if len(different.intersection(window)) >= least:
                best = max(best, self.common(item, window))
        return best / n if best >= self.need[item] else 0.0

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        ws = words(text)
        found = ((item, self.coverage(ws, item, begins)) for item, begins in self.places(ws).items())
        return [(item, c) for item, c in found if c]


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (i, k, k == len(parts) - 1, part)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for parts in [sentences(text)]
            for k, part in enumerate(parts)
        ]
        cols = list(zip(*rows)) if rows else [[]] * 4
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["i", "pos", "last", "ws"])


def item_words(items: DataFrame, shared: int = 3) -> DataFrame:
    """(i, ws): the words of each item (i, t), without closing sentences that ``shared`` different items or more have."""
    rows = items.mapInArrow(_sentence_rows, "i long, pos int, last boolean, ws array<string>")
    texts = items.select("i", F.md5("t").alias("h"))
    ends = rows.where("last and pos > 0 and size(ws) > 0").join(texts, "i").groupBy(F.md5(F.array_join("ws", " ")).alias("key"))
    stock = ends.agg(F.count_distinct("h").alias("n")).where(F.col("n") >= shared).select("key", F.lit(True).alias("stock"))
    marked = rows.withColumn("key", F.md5(F.array_join("ws", " "))).join(stock, "key", "left")
    told = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("stock", F.lit(False)).alias("stock"), "ws")))
    listed = marked.groupBy("i").agg(told.alias("parts"))
    own = F.greatest(F.array_max(F.transform("parts", lambda p: F.when(~p.stock, p.pos))), F.lit(0))
    kept = F.filter("parts", lambda p: p.pos <= own)
    return listed.select("i", F.flatten(F.transform(kept, lambda p: p.ws)).alias("ws")).where("size(ws) > 0")


_MACHINES: dict[str, WuManber] = {}


def _machine(key: str, table: dict[int, list[str]], share: float) -> WuManber:
    """The machine of a block, built once in each worker process."""
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = WuManber(table, share)
    return _MACHINES[key]


def _search(texts: DataFrame, table: dict[int, list[str]], share: float) -> DataFrame:
    key = hashlib.md5(repr((share, sorted(table.items()))).encode()).hexdigest()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared.value, share)
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, c in machine.leaks(text):
                    for col, v in zip(cols, (doc, item, c)):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "class", "coverage"])

    return texts.mapInArrow(go, "doc_id long, class long, coverage double")


def find_leaks(
    texts: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "item_text",
    share: float = 0.6,
    block_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, coverage) of every text that holds at least ``share`` of an item."""
    given = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    given = given.where(F.col("i").isNotNull() & (F.trim("t") != "")).groupBy("i").agg(F.max("t").alias("t"))
    cleaned = cut_lineage(item_words(given).withColumn("h", F.md5(F.array_join("ws", " "))))
    classes = cleaned.groupBy("h").agg(F.min("i").alias("class"), F.any_value("ws").alias("ws"))
    chosen = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    found, block, held = None, {}, 0
    for row in classes.select("class", "ws").toLocalIterator():
        if block and held + len(row["ws"]) > block_words:
            part = _search(chosen, block, share)
            found, block, held = part if found is None else found.unionByName(part), {}, 0
        block[row["class"]] = row["ws"]
        held += len(row["ws"])
    if block or found is None:
        part = _search(chosen, block, share)
        found = part if found is None else found.unionByName(part)
    names = cleaned.select("h", F.col("i").alias("item_id")).join(classes.select("h", "class"), "h").select("class", "item_id")
    best = found.groupBy("doc_id", "class").agg(F.max("coverage").alias("coverage"))
    return best.join(names, "class").select("doc_id", "item_id", "coverage")
