import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab {}();\n\f.#-中é", max_size=400), st.integers(2, 60), st.integers(0, 80), st.sampled_from(["code", "pdf"]))
def test_pieces_cover_the_text(text, most, overlap, kind):
    if len(text) <= most:
        return
    made = S.pieces(text, kind, most, overlap)
    kept = min(overlap, most - 1)
    assert "".join(text[o:e] for _, o, e in made) == text
    assert all(0 < e - s <= most for s, _, e in made)
    assert all(o - s == min(kept, o) for s, o, _ in made[1:])


def test_natural_boundaries():
    text = "def a():\n    x = 1\n    y = 2\n\ndef b():\n    return 3\n"
    assert [text[o:e] for _, o, e in S.pieces(text, "code", 34, 0)] == ["def a():\n    x = 1\n    y = 2\n\n", "def b():\n    return 3\n"]
    text = "# One\n\nFirst part. More.\n\n# Two\n\nSecond part."
    assert [text[o:e] for _, o, e in S.pieces(text, "pdf", 30, 0)] == ["# One\n\nFirst part. More.\n\n", "# Two\n\nSecond part."]


def test_headings_and_markup():
    text = "One\n===\n\nFirst part here.\n\nTwo\n---\n\nSecond part.\n"
    assert [text[o:e] for _, o, e in S.pieces(text, "pdf", 30, 0)] == ["One\n===\n\nFirst part here.\n\n", "Two\n---\n\nSecond part.\n"]
    text = "<div>first <b>part</b></div><div>second part</div><p>x</p>"
    assert [text[o:e] for _, o, e in S.pieces(text, "pdf", 36, 0)] == ["<div>first <b>part</b></div>", "<div>second part</div><p>x</p>"]


def test_table_cases(spark, rows):
    limits = spark.createDataFrame([("code", 10, 2), ("code", 20, 3), ("pdf", None, 1), (None, 5, 1)], "item_kind string, max_chars int, overlap_chars int")
    items = spark.createDataFrame([(1, "x" * 25, 9), (2, "short", 9), (3, None, 9), (4, "", 9), (1, "x" * 25, 9)], "id long, body string, item_kind int")
    got = S.split_items(items, limits, kind=F.lit("code"), item_id=F.col("id"), text=F.col("body"))
    assert {r.item_id for r in got.collect()} == {1}
    assert got.distinct().orderBy("piece_no").first().piece == "x" * 8
    assert S.split_items(items, limits, kind=F.lit("pdf"), item_id=F.col("id"), text=F.col("body")).count() == 0
    assert S.split_items(items.limit(0), limits, kind=F.lit("code"), item_id=F.col("id"), text=F.col("body")).count() == 0


def test_very_long_text():
    rng = random.Random(4)
    text = "".join(rng.choice("abc .\n") for _ in range(300_000))
    made = S.pieces(text, "pdf", 1000, 50)
    assert "".join(text[o:e] for _, o, e in made) == text
