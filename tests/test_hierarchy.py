import random

import pytest

from graphloom.operators import hierarchy as H
from graphloom.operators.components import components


def links(spark, pairs):
    return H.parent_links(spark.createDataFrame(pairs, "src string, dst string"))


def test_tree_with_two_parents_and_root(spark, rows):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    tree = H.tree(links(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), nodes)
    assert rows(tree, "node_id", "depth", "root_id") == [("a", 0, "a"), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "a")]
    assert {r.node_id: r.path for r in tree.collect()}["d"] == ["a", "b", "d"]
    assert rows(H.descendants(tree)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 1)]


def test_cycles_loops_and_what_hangs_below(spark, rows):
    pairs = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("l", "l"), ("l", "m"), ("r", "s"), ("r", "y")]
    assert rows(H.cycles(links(spark, pairs))) == [("a", "a"), ("b", "a"), ("l", "l"), ("m", "l"), ("x", "a"), ("y", "a")]


def test_nulls_unknown_ends_repeats_and_clashing_columns(spark, rows):
    edges = spark.createDataFrame([("a", "b", "z"), ("a", "b", "z"), (None, "b", ""), ("a", None, ""), ("a", "q", "")], "src string, dst string, child string")
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "id string, parent int")
    assert rows(H.parent_links(edges, nodes)) == [("b", "a")]


def test_empty(spark):
    none = links(spark, [])
    assert H.cycles(none).count() == 0
    assert H.tree(none, spark.createDataFrame([], "id string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_functional_graphs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(60)]
    parent = {c: rng.choice(ids) for c in ids if rng.random() < 0.9}
    want = {}
    for c in ids:
        seen, at = [], c
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            want[c] = min(seen[seen.index(at) :])
    got = {r.node_id: r.cycle_id for r in H.cycles(links(spark, [(p, c) for c, p in parent.items()])).collect()}
    assert got == want


def test_long_chain(spark):
    ids = [f"c{k:04d}" for k in range(200)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    tree = H.tree(links(spark, list(zip(ids, ids[1:]))), nodes)
    assert tree.agg({"depth": "max"}).first()[0] == 199


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
