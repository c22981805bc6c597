import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codonloom.operators import step_types as steps
from codonloom.operators.lineage import shared_folder
from codonloom.sources.formats import nexus_commands, nexus_options, nexus_usertypes

SCHEMA = "tree_id long, node_idx int, parent_idx int, name string, is_tip boolean, branch_len double"


def test_user_types_of_a_file(spark, tmp_path):
    (tmp_path / "a.nex").write_text("""#NEXUS
BEGIN ASSUMPTIONS; OPTIONS DEFTYPE=ORD GAPMODE=NEWSTATE;
 USERTYPE tree (CSTREE) = ((A,B)C,D[root left]:1)E;
 USERTYPE 'my type' (STEPMATRIX) = 3 A C G [A] . 1 2 [C] 1 . i [G] 2.5 3 . ;
END;""")
    commands = nexus_commands(spark, str(tmp_path / "a.nex"))
    types = nexus_usertypes(commands)
    assert [(r.name, r.form) for r in types.orderBy("form").collect()] == [("tree", "cstree"), ("my type", "stepmatrix")]
    assert [tuple(r)[2:] for r in nexus_options(commands).collect()] == [("ord", "minsteps", "newstate")]
    matrix = {(r.a, r.b): r.steps for r in steps.matrix_steps(types.filter("form = 'stepmatrix'").select("name", "definition")).collect()}
    assert matrix == {("A", "A"): 0, ("A", "C"): 1, ("A", "G"): 2, ("C", "A"): 1, ("C", "C"): 0, ("C", "G"): None, ("G", "A"): 2.5, ("G", "C"): 3, ("G", "G"): 0}
    with pytest.raises(Exception, match="all cells"):
        steps.matrix_steps(spark.createDataFrame([("x", "2 A C . 1 1")], "name string, definition string")).collect()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_state_trees_equal_walks(spark, n):
    rng = random.Random(n)
    up = {i: rng.randrange(i) for i in range(1, n)}
    kids = {i: [j for j in up if up[j] == i] for i in range(n)}

    def text(i):
        return (f"({','.join(map(text, kids[i]))})" if kids[i] else "") + f"s{i}"

    def way(i):
        return [i, *way(up[i])] if i else [0]

    types = spark.createDataFrame([("t", text(0) + ";")], "name string, newick string")
    got = {(r.a, r.b): r.steps for r in steps.shortest_steps(steps.tree_edges(types)).collect()}
    assert got == {(f"s{i}", f"s{j}"): len(set(way(i)) ^ set(way(j))) for i in range(n) for j in range(n) if n > 1}


def plain(rows, supported):
    """By recursion."""
    kids, at = {}, {r[1]: r for r in rows}
    for r in sorted(rows, key=lambda r: r[1]):
        kids.setdefault(r[2], []).append(r[1])

    def below(i):
        return kids.get(i, [])

    def has(i):
        return i in supported or (len(below(i)) == 1 and has(below(i)[0]))

    def known(i):
        return len(below(i)) == 1 and (at[i][3] is not None or known(below(i)[0]))

    def name(i, k):
        return at[i][3] if at[i][3] is not None or not below(i) else name(below(i)[k], k)

    out = set()
    for _, i, p, own, _, _ in rows:
        if p is not None and below(i) and not has(i) and own is None and not known(i):
            end, hops = i, 0
            while len(below(end)) == 1:
                end, hops = below(end)[0], hops + 1
            sides = (None, None) if at[end][3] is not None else tuple(name(below(end)[k], k) if below(end) else None for k in (0, -1))
            out.add((i, hops, at[end][3], *sides))
    return out


def test_nodes_without_support(spark):
    rng = random.Random(8)
    rows = [(0, 0, None, None, False, 0.0)]
    for i in range(1, 600):
        rows.append((0, i, i - 1 if rng.random() < 0.7 else rng.randrange(i), rng.choice([None, None, None, f"n{i}"]), False, 1.0))
    parents = {r[2] for r in rows}
    rows = [(*r[:3], f"tip{r[1]}", True, 1.0) if r[1] not in parents else r for r in rows]
    supported = rng.sample(range(600), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = steps.unsupported_nodes(df, spark.createDataFrame([(0, i) for i in supported], "tree_id long, node_idx int")).collect()
    assert {tuple(r)[1:] for r in got} == plain(rows, set(supported)) and len(got) > 20


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    rows = [(0, i, i - 1 if i else None, None, False, 1.0) for i in range(n)] + [(0, n, n - 1, "x", True, 1.0), (0, n + 1, n - 1, "y", True, 1.0)]
    got = steps.unsupported_nodes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "tree_id long, node_idx int")).collect()
    assert {tuple(r)[1:] for r in got} == {(i, n - 1 - i, None, "x", "y") for i in range(1, n)}
    assert not steps.unsupported_nodes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, n - 1)], "tree_id long, node_idx int")).collect()


def test_ends_of_chains_and_names_on_the_way(spark):
    """A chain that ends in a held tip is held; the ways stop at named inner nodes."""
    rows = [(0, 0, None, None, False, 0.0), (0, 1, 0, None, False, 1.0), (0, 2, 1, None, True, 1.0), (0, 3, 0, None, False, 1.0), (0, 4, 3, "in", False, 1.0), (0, 5, 4, "a", True, 1.0),
            (0, 6, 3, None, False, 1.0), (0, 7, 6, "b", True, 1.0), (0, 8, 6, "", True, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [{tuple(r)[1:] for r in steps.unsupported_nodes(df, spark.createDataFrame(h, "tree_id long, node_idx int")).collect()} for h in ([(0, 2)], [])]
    assert got[0] == {(3, 0, None, "in", None), (6, 0, None, "b", None)} and got[1] == got[0] | {(1, 1, None, None, None)}


def test_ways_write_in_proportion_to_their_nodes(spark):
    n, folder = 40_000, shared_folder(spark)
    size = lambda: sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())
    inner = spark.range(n).select(F.lit(0).alias("tree_id"), (F.col("id") + n).cast("int").alias("node_idx"), F.when(F.col("id") > 0, F.col("id") + n - 1).cast("int").alias("parent_idx"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_tip"), F.lit(1.0).alias("branch_len"))
    tips = spark.range(n).select(F.lit(0), F.col("id").cast("int"), (F.col("id") + n).cast("int"), F.concat(F.lit("t"), "id"), F.lit(True), F.lit(1.0))
    before = size()
    got = steps.unsupported_nodes(inner.union(tips), spark.createDataFrame([], "tree_id long, node_idx int"))
    assert got.filter(f"leftmost IS NOT NULL AND rightmost = 't{n - 1}'").count() == n - 2
    assert size() - before < 900 * 2 * n  # pointer jumping wrote all nodes in each of its rounds
