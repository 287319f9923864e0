"""Problem 1: source files and pdf texts over their limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import splitting
from graphloom.session import table


def _pieces(spark, sf_dir, files, with_text):
    limits = table(spark, sf_dir, "split_limits")
    docs = table(spark, sf_dir, "documents").where(F.lower(F.trim("doc_type")) == "pdf")
    code = splitting.split_items(
        files, limits, kind=F.lit("code"), item_id=F.col("file_id"), text=F.col("code"), with_text=with_text
    )
    pdf = splitting.split_items(
        docs, limits, kind=F.lit("pdf"), item_id=F.col("doc_id"), text=F.col("text"), with_text=with_text
    )
    return code.unionByName(pdf)


def p1_found(spark, sf_dir):
    rows = _pieces(spark, sf_dir, table(spark, sf_dir, "source_files"), with_text=False)
    return rows.where("piece_no = 1").select("item_kind", "item_id").distinct()


def p1_pieces(spark, sf_dir):
    """The pieces of each item that p1_found names; of differing rows of a file the longest is cut."""
    last = (
        table(spark, sf_dir, "source_files")
        .groupBy("file_id")
        .agg(F.max(F.struct(F.char_length("code").alias("n"), "loaded_at", "code")).alias("last"))
        .select("file_id", "last.code")
    )
    return _pieces(spark, sf_dir, last, with_text=True).distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLE = {
    "p1_found": """
SELECT DISTINCT 'code' AS item_kind, file_id AS item_id FROM source_files
WHERE length(code) > (SELECT min(max_chars) FROM split_limits WHERE item_kind = 'code')
UNION
SELECT DISTINCT 'pdf', doc_id FROM documents
WHERE lower(trim(doc_type)) = 'pdf' AND length(text) > (SELECT min(max_chars) FROM split_limits WHERE item_kind = 'pdf')
"""
}
