import random

import brute
import pytest
from graphloom.operators.hierarchy import ancestor_pairs, decompose, descendants, full_paths
from pyspark.sql import functions as F


def run(spark, links):
    df = spark.createDataFrame([(a, b, 1, "n", "c") for a, b in links], "p string, c string, id int, node string, chain string")
    return decompose(df, "p", "c").cache()


def check(spark, links):
    got = run(spark, links)
    want = brute.hierarchy(links)
    rows = got.collect()
    assert {r.node: (r.root, r.depth, r.state) for r in rows} == {k: v[:3] for k, v in want.items()}
    assert len(rows) == len(want)
    paths = {r.node: r.path for r in full_paths(got).collect()}
    assert paths == {k: v[3] for k, v in want.items() if v[3]}
    below = {(r.node, r.below, r.distance) for r in descendants(got).collect()}
    assert below == {(a, k, len(v[3]) - 1 - i) for k, v in want.items() if v[3] for i, a in enumerate(v[3][:-1])}
    tree = {r.node: r for r in rows if r.state == "tree"}
    for a, b, _ in below:  # preorder intervals hold just the descendants
        assert tree[a].first < tree[b].first <= tree[a].last and tree[a].root == tree[b].root
    for r in tree.values():
        assert r.last - r.first + 1 == r.size == 1 + sum(1 for a, _, _ in below if a == r.node)
    got.unpersist()


def test_random_forest_with_cycles(spark):
    rng = random.Random(7)
    links = [(f"n{rng.randint(0, i - 1)}", f"n{i}") for i in range(1, 60)]
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x2", "y1"), ("y1", "y2"), ("self", "self"), ("self", "under"), ("c1", "c2"), ("c2", "c1")]
    links += [(" \tn0 ", "n1\t"), (None, "alone"), ("caller", None), (None, None), ("", "blank"), ("n0", "n1")]
    rng.shuffle(links)
    check(spark, links)


def test_deep_chain_and_wide_fan(spark):
    check(spark, [(f"d{i:03}", f"d{i + 1:03}") for i in range(70)] + [("d030", f"w{i:03}") for i in range(80)])


def test_long_cycles(spark):
    check(spark, [(f"k{i}", f"k{(i + 1) % 13}") for i in range(13)] + [("k5", "t1"), ("t1", "t2"), ("t2", "t3"), ("t2", "t4")] + [("é", "z"), ("z", "é"), ("𐍈", "")])


@pytest.mark.parametrize("links", [[], [(None, None)], [("a", "b")], [("a", "a")]])
def test_small(spark, links):
    check(spark, links)


def test_two_callers_keep_the_last(spark):
    df = spark.createDataFrame([("a", "c", 1), ("b", "c", 2), ("z", "c", 1)], "p string, c string, at int")
    assert {r.node: r.root for r in decompose(df, "p", "c", "at").collect()}["c"] == "b"


def test_joins_have_as_many_candidates_as_results(spark):
    """A chain of 10,000 with 100,000 leaves at its top: the leaves' paths touch only the places above them."""
    links = spark.range(1, 10_000).selectExpr("concat('d', id - 1) as p", "concat('d', id) as c")
    leaves = spark.range(100_000).selectExpr("concat('d', id % 3) as p", "concat('w', id) as c")
    h = decompose(links.union(leaves), "p", "c", intervals=True).where("state = 'tree'").cache()
    depths = h.agg(F.sum("depth").alias("d"), F.count("*").alias("n")).first()
    assert depths.n == 110_000
    leaf = h.where("node like 'w%'")
    places = leaf.select(F.explode("segments").alias("s")).agg(F.sum(F.col("s.pos") + 1).alias("n")).first().n
    paths = ancestor_pairs(h, leaf)
    assert paths.count() == places == leaf.agg(F.sum(F.col("depth") + 1)).first()[0]
    assert "SortMergeJoin" not in paths._jdf.queryExecution().toString() or "pos <= " not in paths._jdf.queryExecution().toString()
    below = descendants(h.where("node like 'w%' or depth > 9990"))
    assert below.count() == 8 * 9 // 2
    h.unpersist()
