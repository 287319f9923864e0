"""Text rules as column expressions: they stay inside generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no topic.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no nor not of on or our she so "
    "than that the their them then there these they this those to too was we were what when where which who will with you your"
).split()
#: Full-width forms and what they are equal to; the rest of NFKC needs ``nfkc``.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", "") + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "") + " "


def tokens(text: Column) -> Column:
    """Words in lower case: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def narrow(text: Column) -> Column:
    """Full-width letters, digits and marks as ordinary ones."""
    return F.translate(text, WIDE, NARROW)


def nfkc(text: Column) -> Column:
    """The compatibility form of a text; only texts beyond ASCII change, but all go to Python in batches."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return form(text)


def normalize_for_compare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(narrow(text)), r"\s+", " "))


def normalize_for_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(narrow(text)), r"[^\p{L}\p{N}]+", "")


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where some were cut."""
    return F.when(F.char_length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def search_text_quality(text: Column) -> Column:
    """The verdict of the first rule that holds, and why."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "CRITICAL:empty")
        .when(F.char_length(t) < 2, "CRITICAL:short")
        .when(t.rlike(r"^[0-9]+$"), "CRITICAL:digits")
        .when(t.rlike(r"^[^\p{L}\p{N}]+$"), "CRITICAL:punctuation")
        .when(F.lower(t).rlike(r"^(the|this|it|there)\s"), "WARNING:prefix")
        .when(F.lower(t).isin("summary", "details", "information", "content", "topic"), "WARNING:generic")
        .otherwise("GOOD")
    )


def latin_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), 1))


def han_ratio(text: Column) -> Column:
    solid = F.regexp_replace(text, r"\s", "")
    return (F.char_length(solid) - F.char_length(F.regexp_replace(solid, "[一-鿿]", ""))) / F.nullif(F.char_length(solid), F.lit(0))


def anchors(text: Column) -> Column:
    """Distinct anchors of a text: percentages and measures, CamelCase, snake_case, acronyms, in this order."""
    families = (r"([0-9]+(?:\.[0-9]+)?\s?(?:%|percent|ms|seconds|days|megabytes))", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z]+(?:_[a-z]+)+)\b", r"\b([A-Z]{2,})\b")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f), 1) for f in families]))
