"""Trees of any size, depth and number, against walks in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codonloom.operators import trees as tr

SCHEMA = "tree_id long, node_idx int, parent_idx int, name string, is_tip boolean, branch_len double"


def random_tree(tree_id, tips, rng, comb=False):
    """Tips first, then inner nodes; joined at random, or one after the other."""
    up, length, open_, node = {}, {i: round(rng.random() + 0.01, 3) for i in range(2 * tips)}, list(range(tips)), tips
    while len(open_) > 1:
        a = open_.pop(0 if comb else rng.randrange(len(open_)))
        b = open_.pop(0 if comb else rng.randrange(len(open_)))
        up[a] = up[b] = node
        open_.insert(0 if comb else len(open_), node)
        node += 1
    return [(tree_id, i, up.get(i), f"it's {i}" if i < tips else None, i < tips, length[i] if i in up else 0.0) for i in range(node)]


def ancestors(rows):
    up = {r[1]: r[2] for r in rows}
    length = {r[1]: r[5] for r in rows}
    for r in rows:
        at, hops, dist = r[1], 0, 0.0
        while at is not None:
            yield r[1], at, hops, dist
            dist, at, hops = dist + length[at], up[at], hops + 1


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(3)
    return [random_tree(0, 200, rng), random_tree(1, 260, rng), random_tree(2, 501, rng, comb=True), random_tree(3, 1, rng), random_tree(4, 2, rng)]


def test_closure_and_splits(spark, forest):
    df = spark.createDataFrame([r for t in forest for r in t], SCHEMA).repartition(4)
    got = {(r.tree_id, r.desc, r.anc): (r.hops, r.dist) for r in tr.closure(df).collect()}
    want = {(t[0][0], d, a): (h, x) for t in forest for d, a, h, x in ancestors(t)}
    assert got.keys() == want.keys() and max(h for h, _ in want.values()) == 500
    assert all(got[k][0] == h and got[k][1] == pytest.approx(x) for k, (h, x) in want.items())
    sides = []
    for t in forest:
        below = {}
        for d, a, _, _ in ancestors(t):
            if t[d][4]:
                below.setdefault(a, set()).add(d)
        tips = {r[1] for r in t if r[4]}
        sides += [(t[0][0], tuple(sorted(tips - below[r[1]] if 0 in below[r[1]] else below[r[1]]))) for r in t if r[2] is not None and not r[4]]
    assert sorted((r.tree_id, tuple(r.split)) for r in tr.splits(df).collect()) == sorted(sides)


def test_newick_of_any_depth(spark, forest):
    df = spark.createDataFrame([r for t in forest for r in t], SCHEMA).repartition(4)
    texts = spark.createDataFrame(tr.newick(df).collect(), "tree_id long, newick string")
    nodes = {(r.tree_id, r.node_pos): r for r in tr.parse_newick(texts).collect()}
    assert len(nodes) == sum(map(len, forest))
    for t in forest:
        want = {}
        for d, a, h, x in ancestors(t):
            if t[d][4] and t[a][2] is None:
                want[t[d][3]] = (h, round(x, 3))
        got = {}
        for r in nodes.values():
            if r.tree_id == t[0][0] and r.is_tip:
                at, h, x = r, 0, 0.0
                while at.parent_pos is not None:
                    h, x, at = h + 1, x + at.branch_len, nodes[r.tree_id, at.parent_pos]
                got[r.name] = (h, round(x, 3))
        assert got == want


def test_newick_details(spark):
    texts = [(0, "[&R] ('a (b)':1,[note]c d : 2.5 [x],'it''s':.5)r:0;rest"), (1, "[n][&u](a,b);"), (2, "a;"), (3, "(a,(b,c)d)")]
    df = spark.createDataFrame(texts, "tree_id long, newick string")
    got = [(r.tree_id, r.name, r.is_tip, r.branch_len) for r in tr.parse_newick(df).orderBy("tree_id", "node_pos").collect()]
    assert got[:4] == [(0, "r", False, 0.0), (0, "a (b)", True, 1.0), (0, "c d", True, 2.5), (0, "it's", True, 0.5)]
    assert got[4:8] == [(1, None, False, 0.0), (1, "a", True, 0.0), (1, "b", True, 0.0), (2, "a", True, 0.0)]
    assert [g[1] for g in got[8:]] == [None, "a", "d", "b", "c"]
    assert {r.tree_id: r.rooted for r in tr.rooting(df).collect()} == {0: True, 1: False, 2: None, 3: None}


def test_many_trees(spark):
    """20,000 trees of 31 nodes: more rows than a recursive query may return."""
    one = random_tree(0, 16, random.Random(5))
    df = spark.createDataFrame(one, SCHEMA).drop("tree_id").crossJoin(spark.range(20_000).withColumnRenamed("id", "tree_id"))
    got = tr.split_frequencies(df).collect()  # both edges of a root with two children are one split
    assert {r.n_trees for r in got} <= {20_000, 40_000} and len(got) == len({tuple(r.split) for r in got})
    assert tr.closure(df).count() == 20_000 * len(list(ancestors(one)))


def test_cycles_are_refused(spark):
    df = spark.createDataFrame([(0, 1, 2, "a", True, 1.0), (0, 2, 1, "b", False, 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="ancestor"):
        tr.closure(df)
    assert tr.closure(df.filter(F.lit(False))).count() == 0
