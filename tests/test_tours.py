"""Euler tours, ranges and split prints of large and odd trees, against walks in plain Python."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_trees import SCHEMA, ancestors, random_tree

from codonloom.operators import trees as tr
from codonloom.operators.lineage import shared_folder
from codonloom.operators.ordered import best_of_range, range_table, running
from codonloom.streaming.tree_stream import split_totals, watch_splits


def test_a_comb_of_many_tips(spark):
    """As deep as it has tips: places, tips below and lengths of every node."""
    n = 30_000
    inner = spark.range(n - 1).select(F.lit(0).alias("tree_id"), (F.col("id") + n).cast("int").alias("node_idx"), F.when(F.col("id") > 0, F.col("id") + n - 1).cast("int").alias("parent_idx"), F.lit(False).alias("is_tip"), F.when(F.col("id") > 0, 0.5).otherwise(0.0).alias("branch_len"))
    tips = spark.range(n).select(F.lit(0), F.col("id").cast("int"), (F.least("id", F.lit(n - 2)) + n).cast("int"), F.lit(True), F.lit(1.0))
    got = tr.tour(inner.union(tips)).toPandas().set_index("node_idx").sort_index()
    i = got.index.to_numpy()
    tip, k = i < n, i.clip(max=n - 2) * (i < n) + (i - n) * (i >= n)
    assert (got["depth"].to_numpy() == k + tip).all()
    assert (got["n_tips"].to_numpy() == [1 if t else n - x for t, x in zip(tip, k)]).all()
    assert abs(got["dist"].to_numpy() - (0.5 * k + tip)).max() < 1e-6
    assert got["pre_order"].is_unique and got["post_order"].is_unique
    assert (got["pre_order"].to_numpy()[~tip] == 2 * k[~tip]).all()  # a tip's number is below an inner node's


def test_shrinking_lists_give_the_same_places(spark, forest):
    """Ranked by rounds of leaving rows or by pointer jumping alone; with children of every kind."""
    rng = random.Random(5)
    wild = [(99, 0, None, None, False, 0.0)] + [(99, i, i - 1 if rng.random() < 0.6 else rng.randrange(i), None, rng.random() < 0.5, float(rng.randrange(9))) for i in range(1, 900)]
    df = spark.createDataFrame([r for t in forest for r in t] + wild, SCHEMA)
    jumped, shrunk = ({(r.tree_id, r.node_idx): r.asDict() for r in tr.tour(df, few=few).collect()} for few in (10**6, 1))
    assert jumped.keys() == shrunk.keys() and len(jumped) == df.count()
    for k, r in jumped.items():
        assert abs(r.pop("dist") - shrunk[k].pop("dist")) < 1e-9 and r == shrunk[k]
    kids, order = {}, []
    for r in wild[1:]:
        kids.setdefault(r[2], []).append(r[1])
    todo = [0]
    while todo:
        order.append(todo.pop())
        todo += reversed(kids.get(order[-1], []))
    assert [k for k in sorted((k for k in shrunk if k[0] == 99), key=lambda k: shrunk[k]["pre_order"])] == [(99, i) for i in order]
    with pytest.raises(ValueError, match="ancestor"):
        tr.tour(spark.createDataFrame([(0, 1, 2, "a", True, 1.0), (0, 2, 1, "b", False, 1.0)], SCHEMA), few=1)


def test_a_tour_writes_in_proportion_to_its_nodes(spark):
    n, folder = 40_000, shared_folder(spark)
    size = lambda: sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())
    inner = spark.range(n).select(F.lit(0).alias("tree_id"), (F.col("id") + n).cast("int").alias("node_idx"), F.when(F.col("id") > 0, F.col("id") + n - 1).cast("int").alias("parent_idx"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_tip"), F.lit(1.0).alias("branch_len"))
    tips = spark.range(n).select(F.lit(0), F.col("id").cast("int"), (F.col("id") + n).cast("int"), F.lit(None).cast("string"), F.lit(True), F.lit(1.0))
    before = size()
    assert tr.tour(inner.union(tips)).agg(F.max("depth")).first()[0] == n
    assert size() - before < 600 * 2 * n  # each round of pointer jumping wrote all steps: 1.4 kB a node


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(11)
    return [random_tree(t, rng.choice([2, 9, 40]), rng, comb=t % 4 == 0) for t in range(12)]


def test_paths_and_matrices(spark, forest):
    df = spark.createDataFrame([r for t in forest for r in t], SCHEMA)
    want, up = {}, {}
    for t in forest:
        for d, a, h, x in ancestors(t):
            up.setdefault((t[0][0], d), {})[a] = (h, x)
        tips = [r[1] for r in t if r[4]]
        for a in tips:
            for b in tips:
                if a != b:
                    one, two = up[t[0][0], a], up[t[0][0], b]
                    m = min(set(one) & set(two), key=lambda c: one[c][0])
                    want[t[0][0], a, b] = (m, one[m][0] + two[m][0], one[m][1], two[m][1])
    got = {(r.tree_id, r.tip_a, r.tip_b): r for r in tr.paths(df).collect()}
    assert set(got) == {k for k in want if k[1] < k[2]}
    assert all((got[k].mrca, got[k].edges) == want[k][:2] and abs(got[k].to_a - want[k][2]) < 1e-9 and abs(got[k].to_b - want[k][3]) < 1e-9 for k in got)
    for mode in (False, True):
        for r in tr.patristic_matrix(df, mode).collect():
            row = [None if r.tip == j else want[r.tree_id, r.tip, j][2] + (0 if mode else want[r.tree_id, r.tip, j][3]) for j in range(len(r.distances))]
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(r.distances, row))


def test_frequencies_by_prints(spark, forest):
    same = [(t, *r[1:]) for t in range(20) for r in forest[1 + t % 2 * 4]]
    counts = {}
    for t in range(20):
        rows = [r for r in same if r[0] == t]
        below = {}
        for d, a, _, _ in ancestors(rows):
            if d < sum(r[4] for r in rows):
                below.setdefault(a, set()).add(d)
        tips = {r[1] for r in rows if r[4]}
        for r in rows:
            if r[2] is not None and not r[4]:
                side = tuple(sorted(tips - below[r[1]] if 0 in below[r[1]] else below[r[1]]))
                counts[side] = counts.get(side, 0) + 1
    got = tr.split_frequencies(spark.createDataFrame(same, SCHEMA)).collect()
    assert {tuple(r.split): r.n_trees for r in got} == counts


def test_stream_of_trees_goes_on(spark, tmp_path, forest):
    """Files that come later are added once; the totals are those of all trees at once."""
    trees = [spark.createDataFrame([(t, *r[1:]) for r in forest[1]], SCHEMA) for t in range(3)]
    at = [str(tmp_path / x) for x in ("in", "out", "check")]
    for more in ([0, 1], [2], []):
        for t in more:
            trees[t].coalesce(1).write.mode("append").parquet(at[0])
        watch_splits(spark, *at, files_per_trigger=1).awaitTermination()
    whole = tr.split_frequencies(trees[0].union(trees[1]).union(trees[2])).collect()
    assert {tuple(r.split): r.n_edges for r in split_totals(spark, at[1]).collect()} == {tuple(r.split): r.n_trees for r in whole}


def test_running_and_ranges(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(100)) for k in ("a", "b") for i in range(300 if k == "a" else 1)]
    df = spark.createDataFrame(rows, "key string, i long, v long").repartition(7)
    for fold, plain in (("sum", sum), ("max", max)):
        got = {(r.key, r.i): r.x for r in running(df, ["key"], ["i"], fold, x=F.col("v")).collect()}
        assert all(got[k, i] == plain(v for kk, j, v in rows if kk == k and j <= i) for k, i, _ in rows)
    table = range_table(df.withColumnRenamed("i", "k"), ["key"], F.greatest)
    asked = [("a", lo, hi) for lo, hi in ((0, 0), (0, 299), (7, 9), (100, 227))] + [("b", 0, 0)]
    got = best_of_range(spark.createDataFrame(asked, "key string, lo long, hi long"), table, ["key"], F.greatest).collect()
    assert {(r.key, r.lo, r.hi): r.v for r in got} == {(k, lo, hi): max(v for kk, i, v in rows if kk == k and lo <= i <= hi) for k, lo, hi in asked}
