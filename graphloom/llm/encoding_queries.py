"""Problem 8: token ids of every document."""

from __future__ import annotations

from graphloom.llm import encoding
from graphloom.session import table


def p8_ids(spark, sf_dir):
    return encoding.encode_texts(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
