"""The operators on small test tables against plain computations over all rows."""

import json
import os
import re
import xml.parsers.expat
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from graphloom.llm import file_origin, near_duplicates, syntax_errors
from graphloom.llm.syntax.files import python_exact
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def read(name, columns):
    return pq.read_table(f"{SF}/{name}.parquet", columns=columns).to_pylist()


def exact(language, code):
    """The verdict of the standard library's parsers; comments only and nothing are valid."""
    if language == "python":
        return python_exact(code.replace("\r\n", "\n").removeprefix("﻿"))
    if language == "json":
        if not re.sub(r"//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*", "", code).strip():
            return True
        try:
            json.loads(code)
        except ValueError:
            return False
        return "NaN" not in code and "Infinity" not in code
    if not re.sub(r"<!--[\s\S]*?-->", "", code).strip():
        return True
    try:
        xml.parsers.expat.ParserCreate().Parse(code.encode(), True)
    except xml.parsers.expat.ExpatError:
        return False
    return True


def test_syntax_as_the_exact_parsers(spark):
    by_end = {"py": "python", "json": "json", "xml": "xml"}
    want, checked = set(), set()
    for r in read("source_files", ["file_id", "file_path", "language", "code"]):
        language = (r["language"] or "").strip().lower() or by_end.get((r["file_path"] or "").rpartition(".")[2].lower(), "")
        language = {"py": "python", "python3": "python"}.get(language, language)
        if language in by_end.values() and r["code"] is not None:
            checked.add(r["file_id"])
            if not exact(language, r["code"]):
                want.add(r["file_id"])
    got = {r.file_id for r in syntax_errors.invalid_files(spark.read.parquet(f"{SF}/source_files.parquet")).collect()}
    assert len(want) > 5 and got & checked == want


def test_near_duplicates_as_all_pairs(spark):
    kinds = ("function_definition", "method_declaration", "method_definition")
    last = {}
    for r in sorted((r for r in read("nodes", ["id", "node_type", "code", "loaded_at"]) if r["node_type"] in kinds and r["id"] and r["code"] is not None), key=lambda r: str(r["loaded_at"])):
        last[r["id"]] = r["code"]
    texts = dict(sorted(last.items())[:450])  # all pairs of a part of the records, which is compared with the same part
    rows = spark.createDataFrame([(i, t, "1") for i, t in texts.items()], "id string, code string, loaded_at string")
    assert {tuple(r) for r in near_duplicates.similar_pairs(rows).collect()} == brute(texts)


def test_copies_as_a_plain_index(spark):
    files = spark.read.parquet(f"{SF}/source_files.parquet")
    signals = file_origin.signals(files)
    places = defaultdict(set)
    for r in signals.select("project", "path", "h").collect():
        if r.h is not None:
            places[r.h].add((r.project, r.path))
    want = {p for held in places.values() if len({project for project, _ in held}) > 1 for p in held}
    got = {(r.project, r.path) for r in file_origin.copied_files(signals).collect()}
    assert want and got == want
