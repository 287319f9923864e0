"""Encoding every text with a public byte-level BPE, and decoding it again.

Texts are encoded by tiktoken from a local rank file. A long text is cut before
it is encoded, at places where the splitting pattern begins a new match whatever
lies around: no match reaches from a character that isn't white space into white
space, nor from an ASCII letter into an ASCII digit. The ids of the parts, joined,
are therefore the ids of the whole. A text without any such place is encoded as
one part.

Defined results for odd input
-----------------------------
* Null and empty texts have an empty list of ids.
* The strings of special tokens are ordinary text.
* Lone surrogates can't occur: Spark's strings are UTF-8.
* One row comes out for each row that goes in, repeated or not.
* Other columns are dropped. Ids that are null stay null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART_CHARS = 100_000

# before white space, between a Latin letter and a digit, between a letter and a mark other than an apostrophe
_SAFE = re.compile(r"(?<=\S)\s|(?<=[A-Za-z])[0-9]|(?<=[^\W\d_])[^\w\s']")


@lru_cache(maxsize=4)
def encoder(ranks_path: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file; made once in each Python worker."""
    import tiktoken

    ranks = {}
    with open(ranks_path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("graphloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, encoding, size: int = PART_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for part in parts(text, size) for i in encoding.encode_ordinary(part)]


def encode_texts(
    texts: DataFrame, *, id_col: str, text_col: str, ranks_path: str = RANKS, pattern: str = PATTERN
) -> DataFrame:
    """(id_col, ids): the token ids of every text."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for batch in batches:
            ids = [encode(text, encoding) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    chosen = texts.select(F.col(id_col), F.col(text_col))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_texts(rows: DataFrame, *, id_col: str, ids_col: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """(id_col, text): the texts of token ids, joined as raw bytes before they are read as UTF-8.

    Null ids give null; ids that don't end at a character's end give U+FFFD there.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path)
        for batch in batches:
            texts = [
                None if ids is None else encoding.decode_bytes(ids).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
