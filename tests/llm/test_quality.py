import random

import pytest

from graphloom.llm import quality as Q

PROSE = "The old index still works, although it is slower than the new one by a factor of about ten."
SAMPLES = {
    "prose": [PROSE, "Der Index wird erst dann neu aufgebaut, wenn der alte nicht mehr gültig ist.", "系统会先读取数据，再根据调用关系更新它的权重。", f"Title\n\n{PROSE}\n- one\n- two\n",
              "1. Open the file and check that it is empty.\n2. If it is not, ask the owner of the table.", "user: Does anyone know who owns the rule?\nagent: It is the one that you asked for.", "Shown in two\nlines, because it was\nwrapped at a width."],
    "table": ["a;b;c\n1;2;3\n4;5;6\n7;8;9", "host: alpha\nport: 99\nmode: null\nsize: 12", "See the data below.\n" + "x | y | z\n---|---|---\n" + "1 | 2 | 3\n" * 12],
    "list": ["- red fox\n- blue sky\n- green tea\n- old map", "alpha, beta, gamma, delta, epsilon, zeta, eta"],
    "junk": ["%$ #@ {}[] ^&* 12 !! ~~ <> ;9 9$", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgdGV4dA" * 6],
    "blank": ["", "  \n\t", None],
}


def test_classes(spark):
    flat = [(f"{kind}", text) for kind, texts in SAMPLES.items() for text in texts]
    df = spark.createDataFrame([(k, t, 0) for k, (_, t) in enumerate(flat)] + [(None, PROSE, 0), (0, flat[0][1], 0)], "doc_id long, text string, n_chars int")
    for size in (1_000_000, 7):
        got = {r.doc_id: r.quality for r in Q.text_statistics(df, chunk_chars=size).collect()}
        assert got == {k: kind for k, (kind, _) in enumerate(flat)}
    assert Q.text_statistics(df.limit(0)).count() == 0


def test_ratios(spark):
    df = spark.createDataFrame([(1, "Two words.\nab 12 -", "")], "doc_id long, text string, n_words string")
    r = Q.text_statistics(df).first()
    assert (r.n_words, r.n_lines, r.mean_word_length, r.ended_line_share) == (3, 2, pytest.approx(10 / 3, abs=1e-5), 0.5)


TOKENS = ["the ", "and ", "x;", "字", "的", "9", ". ", "- a", "don't ", "。", "? ", "   ", "| ", "wörd", "Bob: ", '."', "=", "\t"]


def pieces(text, size):
    out = []
    for line, fresh, token, word, part in Q.chunks(text, size):
        out.append((line, Q.count_lines(part) if line < 0 else Q.piece(part, fresh, token, word)))
    return out


def test_pieces_are_associative_and_add_up_to_the_line():
    rng = random.Random(5)
    for k in range(120):
        unit = "".join(rng.choice(TOKENS) for _ in range(rng.randrange(1, 60)))
        text = (rng.choice(["", "Ann Lee: ", "- ", "2024-01-01 10:00 ", "key = "]) + unit * 60 + rng.choice(["", "a" * 900, "!" * 700]) + unit * 9).replace("\n", "")
        parts = [p for _, p in pieces(text, 330)]
        if len(parts) < 3 or isinstance(parts[0], list):
            continue
        left = parts[0]
        for p in parts[1:]:
            left = Q.add(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = Q.add(p, right)
        assert left == right
        assert Q.close(left) == Q.count_lines(text), text[:200]
        assert len(str(left)) < 2000


def test_chunks_cover_the_text():
    text = ("word " * 400 + "\n" + "a" * 1000 + " b\n\nshort\n") * 3
    parts = list(Q.chunks(text, 320))
    joined = "".join(("\n" if k and fresh else "") + part for k, (_, fresh, _, _, part) in enumerate(parts))
    assert joined.rstrip("\n") == text.rstrip("\n") and max(len(p[-1]) for p in parts) <= 330


def test_length_makes_no_difference(spark):
    """Every document of a test table in one piece, and in chunks that are summed over partitions."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are missing")
    docs = spark.read.parquet(path)
    one_line = docs.selectExpr("doc_id + 1000000 as doc_id", "replace(text, '\n', ' ') as text")
    docs = docs.select("doc_id", "text").unionByName(one_line)
    whole, cut = (sorted(map(tuple, Q.text_statistics(docs, chunk_chars=size).collect())) for size in (1_000_000, 320))
    assert whole == cut
