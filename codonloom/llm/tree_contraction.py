"""Totals over every subtree of a forest, by parallel tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.llm.common import cut

#: Bits of a level that choose the nodes to compress before hashes do.
LEVEL_BITS = 24


def coin(node: Column, level: Column, turn: int) -> Column:
    """Whether a node may be spliced out in this round, if it has one child of another
    coin. The bits of the levels halve a chain each round; later a hash."""
    if turn < LEVEL_BITS:
        return F.shiftright(level, turn) % 2 == 1
    return F.xxhash64(node, F.lit(turn)) % 2 == 0


def subtree_totals(forest: DataFrame, values: list[str]) -> DataFrame:
    """(id, parent, level, *values) to (id, *values): sums over the node and all below it.

    id, parent: longs; the parent of a root is null. level: the node's depth. Rounds of
    two steps each until nothing is left. Rake: a node without children is done, and
    its sums go to its parent. Compress: of a node with a single child every other is
    spliced out, so that its child hangs on its parent and carries its sums up with its
    own; two spliced nodes never touch. Then the spliced nodes are filled in from the
    last round to the first: their own sums, what their child carried, and its total. A round keeps at most about half of a chain, so chains
    of n nodes take log2(n) rounds, as bushy trees do.

    Every step is a join or a grouping by node, with sums before the shuffle, so a node
    may have any number of children. Each round is written to the checkpoint folder;
    the driver sees counts only. Cycles never become leaves and raise an error.
    """
    carried = [f"_on_{v}" for v in values]
    columns = ["id", "parent", "level", *values, *carried]
    live = cut(forest.select("id", "parent", "level", *values, *[F.lit(0).cast("long").alias(c) for c in carried]))
    n, turn = live.count(), 0
    done: list[DataFrame] = []
    spliced: list[tuple[int, DataFrame, int]] = []
    while n:
        kids = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("_k"))
        marked = live.join(kids, "id", "left").withColumn("_leaf", F.col("_k").isNull())
        sums = marked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.when(F.col("_leaf"), F.col(v) + F.col(c)).otherwise(0)).alias(f"_{v}") for v, c in zip(values, carried)],
            F.count_if(~F.col("_leaf")).alias("_left"), F.max(F.when(~F.col("_leaf"), F.struct("id", "level", *carried))).alias("_child"),
        )
        raked = marked.join(sums, "id", "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values})
        single = F.col("parent").isNotNull() & (F.col("_left") == 1)
        out = single & coin(F.col("id"), F.col("level"), turn) & ~coin(F.col("_child.id"), F.col("_child.level"), turn)
        raked = cut(raked.select(*columns, "_leaf", "_child", F.coalesce(out, F.lit(False)).alias("_out")), n)
        n_leaf, n_out = raked.agg(F.count_if("_leaf"), F.count_if("_out")).first()
        if not n_leaf:
            raise ValueError("a node is its own ancestor")
        done.append(raked.filter("_leaf").select("id", *values))
        gone = raked.filter("_out")
        if n_out:
            spliced.append((len(done), gone.select("id", F.col("_child.id").alias("child"), *[(F.col(v) + F.col(f"_child.{c}")).alias(v) for v, c in zip(values, carried)]), n_out))
        n, turn = n - n_leaf - n_out, turn + 1
        rest = raked.filter("NOT _leaf AND NOT _out").select(*columns)
        if n_out:
            up = gone.select(F.col("_child.id").alias("id"), F.col("parent").alias("_up"), *[(F.col(v) + F.col(c)).alias(f"_{v}") for v, c in zip(values, carried)])
            more = {c: F.col(c) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v, c in zip(values, carried)}
            rest = rest.join(up, "id", "left").withColumns({"parent": F.coalesce("_up", "parent"), **more}).select(*columns)
        if n:
            live = cut(rest, n)
    filled: list[DataFrame] = []
    for rounds, part, rows in reversed(spliced):
        later = done[rounds:] + filled  # what was still there after that round
        totals = later[0]
        for more in later[1:]:
            totals = totals.union(more)
        below = totals.select(F.col("id").alias("child"), *[F.col(v).alias(f"_{v}") for v in values])
        filled.append(cut(part.join(below, "child").select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]), rows))
    out, *others = [*done, *filled] or [live]
    for more in others:
        out = out.union(more)
    return out.select("id", *values)
