"""Problem 2: credentials in source_files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import credentials
from graphloom.session import table


def p2_found(spark, sf_dir):
    found = credentials.find_credentials(table(spark, sf_dir, "source_files"))
    return found.select("file_id", "line_no").distinct()


def p2_redacted(spark, sf_dir):
    files = (
        table(spark, sf_dir, "source_files")
        .groupBy("file_id")
        .agg(F.max(F.struct("loaded_at", "file_path", "code")).alias("f"))
        .select("file_id", "f.file_path", "f.code")
    )
    return credentials.redact(files)


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLE: dict[str, str] = {}
