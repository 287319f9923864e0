import itertools
import random
import re

from graphloom.llm import near_duplicates as N

SCHEMA = "id string, code string, loaded_at string, h int, n int"


def brute(texts, gram=4, threshold=0.5):
    sets = {}
    for i, t in texts.items():
        words = re.findall(N.TOKEN, re.sub(r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*", " ", t), re.A)
        sets[i] = {tuple(words[k : k + gram]) for k in range(max(1, len(words) - gram + 1))} if words else set()
    return {
        (a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    }


def test_against_brute_force_with_large_families(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    texts = {}
    for k in range(120):
        words = list(rng.choice(base[: 3 if k < 80 else 12]))
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 2)] = [f"new{rng.randrange(9)}"] * rng.randrange(0, 2)
        texts[f"r{k:03d}"] = " ".join(words) + rng.choice(["", " # note", "\n"])
    df = spark.createDataFrame([(i, t, "1", 0, 0) for i, t in texts.items()], SCHEMA)
    for rare, options in ((2, {}), (32, {}), (2, {"hot_rows": 4, "share": 2}), (0, {"hot_rows": 1, "share": 1})):
        got = {tuple(r) for r in N.similar_pairs(df, rare=rare, **options).collect()}
        assert got == brute(texts)


def test_short_texts_of_frequent_tokens(spark):
    rng = random.Random(7)
    texts = {f"r{k:03d}": " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for k in range(150)}
    df = spark.createDataFrame([(i, t, "1", 0, 0) for i, t in texts.items()], SCHEMA)
    for rare in (1, 3):
        assert {tuple(r) for r in N.similar_pairs(df, rare=rare).collect()} == brute(texts)


def test_odd_rows(spark, rows):
    body = "a = f(b, c) + g(d) - h(e)"
    data = [("x", body, "1", 0, 0), ("y", body + "  # same", "1", 0, 0), ("y", "old text", "0", 0, 0), ("z", None, "1", 0, 0), (None, body, "1", 0, 0),
            ("e1", "", "1", 0, 0), ("e2", "# only", "1", 0, 0), ("s1", "a b", None, 0, 0), ("s2", "a  b", "1", 0, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(N.similar_pairs(df)) == [("s1", "s2"), ("x", "y")]
    groups = {r.id: (r.class_id, r.group_id, r.n_links) for r in N.similar_groups(df).collect()}
    assert groups["x"] == groups["y"] == ("x", "x", 0)
    assert N.similar_pairs(df.limit(0)).count() == 0
