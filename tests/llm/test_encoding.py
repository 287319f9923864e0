import os

import pytest

from graphloom.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.RANKS), reason="the rank file is missing")


def test_parts_give_the_ids_of_the_whole():
    enc = E.encoder()
    text = "It's 12abc34  naïve\n\n 中文 don't;x9y8 <|endoftext|>\t end " * 40
    for size in (1, 7, 50, 333):
        assert E.encode(text, enc, size) == enc.encode_ordinary(text)
    assert E.encode("a" * 3000, enc, 100) == enc.encode_ordinary("a" * 3000)


def test_long_texts_without_spaces():
    enc = E.encoder()
    text = "系统会先读取数据，再根据调用关系更新它的权重。是café、naïve…吗？" * 6000
    got = list(E.parts(text))
    assert len(got) > 1 and "".join(got) == text and E.encode(text, enc) == enc.encode_ordinary(text)


def test_part_size_makes_no_difference_on_a_table():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are missing")
    enc = E.encoder()
    for row in pq.read_table(path, columns=["text"]).to_pylist():
        assert E.encode(row["text"], enc, 40) == E.encode(row["text"], enc)


def test_tables(spark, rows):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (1, "hello world", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    out = E.encode_texts(df, id_col="doc_id", text_col="text")
    got = sorted(((r.doc_id, r.ids) for r in out.collect()), key=str)
    assert got.count((1, [31373, 995])) == 2 and (2, []) in got and (3, []) in got
    back = {r.doc_id: r.text for r in E.decode_texts(out, id_col="doc_id").collect()}
    assert back[1] == "hello world" and back[2] == ""
    assert E.encode_texts(df.limit(0), id_col="doc_id", text_col="text").count() == 0
