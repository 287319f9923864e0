import random

from graphloom.llm import leakage as L

ITEM = "Given nine idle workers the third queue must drain `first_task` before seven late readers return their open tickets again"
STOCK = "Answer with one word and give no reason."


def search(spark, texts, items, **options):
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, coverage string")
    tests = spark.createDataFrame([(*i, 0) for i in items], "item_id long, item_text string, doc_id int")
    return sorted((r.doc_id, r.item_id) for r in L.find_leaks(docs, tests, **options).collect())


def test_forms_of_one_passage(spark):
    words = ITEM.split()
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    texts = [
        (1, f"Before. {ITEM}. After."),
        (2, ITEM.upper().replace(" ", "  \n * ")),
        (3, "<p>" + ITEM.replace("third", "<b>third</b>").replace("`", "&#96;") + "</p>"),
        (4, ITEM.replace("workers", "work-\ners").replace("queue", "qu\u200beue").replace("readers", "re\u00adaders")),
        (5, " ".join(w for k, w in enumerate(words) if k % 9)),
        (6, " ".join(words[: int(len(words) * 0.7)])),
        (7, " ".join(words[: int(len(words) * 0.4)])),
        (8, " ".join(shuffled)),
        (9, STOCK),
        (10, None),
        (11, " \n"),
        (1, f"Before. {ITEM}. After."),
        (12, ITEM + " filler" * 40_000),
        (13, " ".join(w + " and other words in between here" for w in words)),
    ]
    items = [(1, f"{ITEM}. {STOCK}"), (2, f"Another item about other things entirely. {STOCK}"), (3, f"Still one more that nobody quotes. {STOCK}"), (4, None), (5, ""), (6, "too short")]
    assert search(spark, texts, items) == [(k, 1) for k in (1, 2, 3, 4, 5, 6, 12)]
    assert search(spark, texts, items, block_words=1) == [(k, 1) for k in (1, 2, 3, 4, 5, 6, 12)]
    assert search(spark, [], items) == [] == search(spark, texts, [])


def test_replaced_inserted_and_unspaced_words(spark):
    ws = ITEM.split() + "while four quiet writers count".split()
    third = " ".join("other" if k % 3 == 2 else w for k, w in enumerate(ws[:24]))
    inserted = " ".join(w + (" indeed" if k % 9 == 4 else "") for k, w in enumerate(ws))
    han = "请根据下面给出的材料计算每个队列中剩余任务的数量"
    texts = [(1, f"x y {third} z"), (2, inserted), (3, f"前文。{han}。后文"), (4, "前文" + han[::-1]), (5, f"a {han[:6]} b"), (6, "alpha beta"), (7, "alpha of beta"), (8, "beta alpha"), (9, "one gamma two"),
             (10, "one three five"), (11, "one two"), (12, "five three one")]
    items = [(1, " ".join(ws[:24])), (2, " ".join(ws)), (3, han), (4, "alpha beta"), (5, "gamma"), (6, "one two three four five"), (7, "!!"), (8, "gamma")]
    want = [(1, 1), (2, 2), (3, 3), (6, 4), (7, 4), (9, 5), (9, 8), (10, 6)]
    found = search(spark, texts, items)
    assert [x for x in found if x not in ((1, 2), (2, 1))] == want  # items 1 and 2 overlap
    assert search(spark, texts, items, block_words=1) == found


def test_stock_endings(spark, rows):
    items = [(k, f"Item number {k} asks for things. {STOCK}") for k in range(3)] + [(3, f"{STOCK} {STOCK}"), (4, "只有一句。请回答。"), (5, STOCK), (6, f"A. B? {STOCK}\n {STOCK}")]
    got = dict(rows(L.item_words(spark.createDataFrame(items, "i long, t string"))))
    stock = L.words(STOCK)
    assert got[0] == "item number 0 asks for things".split() and got[3] == stock == got[5] and got[6] == ["a", "b"]
    assert got[4] == list("只有一句请回答")


def test_pairs_against_plain_search():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    items = {i: [rng.choice(vocabulary) for _ in range(12)] for i in range(6)}
    text = [rng.choice(vocabulary) for _ in range(4000)]
    # at a share of 0.66 no pair of 12 words can be spared, at 0.9 some can
    short, spared = ({(i, p) for i, ps in L.WuManber(items, share).places(text).items() for p in ps} for share in (0.66, 0.9))
    want = {(i, t - k) for i, ws in items.items() for k in range(11) for t in range(3999) if text[t : t + 2] == ws[k : k + 2]}
    assert short == want and spared < want and {i for i, _ in spared} == set(items)


def test_recall_on_a_table():
    """Every document against every item by brute force over windows."""
    import os

    import pyarrow.parquet as pq
    import pytest

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are missing")
    items = {r["item_id"]: L.words(r["item_text"]) for r in pq.read_table(f"{sf}/eval_items.parquet").to_pylist()}
    machine = L.WuManber(items, 0.6)
    found = brute = 0
    for row in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).to_pylist():
        text = L.words(row["text"])
        have = set(text)
        for i, ws in items.items():
            n, least = len(ws), len(machine.sets[i]) - (len(ws) - machine.need[i])
            if len(have & machine.sets[i]) >= least and machine.common(i, text) >= machine.need[i]:
                brute += any(machine.common(i, text[k : k + n + n // 3]) >= machine.need[i] for k in range(max(1, len(text) - n // 2)))
        found += len(machine.leaks(row["text"]))
    assert brute > 30 and found >= 0.99 * brute


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert L.WuManber({0: a}).common(0, b) == plain(a, b)
