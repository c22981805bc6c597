"""Which lines of a file begin a sequence, where sequences run over lines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.operators.lineage import cut
from codonloom.operators.ordered import running

#: Lines that one task follows step by step.
BLOCK = 4096


def following(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, need, n_all, n_rest) to (keys, pos, at, next): the number of each line
    and that of the line after the sequence that a name on this line would begin.

    With running sums s of the cells, that sequence ends at the first line whose sum is
    at least s + need - n_rest: sums and goals are sorted together, and a goal's place
    among the sums is that line. No line is held with another."""
    at = running(rows.select(*keys, "pos", "need", "n_all", "n_rest"), keys, ["pos"], s=F.col("n_all").cast("long"), at=F.lit(1).cast("long"))
    goal = F.col("s") + F.col("need") - F.col("n_rest")
    both = at.select(*keys, F.col("s").alias("v"), F.lit(1).cast("long").alias("is_sum"), "at", "pos").union(at.select(*keys, goal, F.lit(0).cast("long"), "at", "pos"))
    placed = running(both, keys, ["v", "is_sum", "at"], below=F.col("is_sum"))
    return placed.filter("is_sum = 0").select(*keys, "pos", "at", (F.greatest(F.col("below") + 1, F.col("at")) + 1).alias("next"))


def way_out(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds out: where the steps from each line of a block lead that leaves the block."""
    rows = rows.sort_values("at", ignore_index=True)
    first, to = int(rows["at"].iloc[0]), rows["next"].tolist()
    end = first + len(to)
    for i in range(len(to) - 1, -1, -1):
        if to[i] < end:
            to[i] = to[to[i] - first]
    return rows.assign(out=np.array(to, np.int64))


def walked(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds begins: whether the steps from the block's entry, if any, reach a line."""
    rows = rows.sort_values("at", ignore_index=True)
    first, to, begins = int(rows["at"].iloc[0]), rows["next"].tolist(), np.zeros(len(rows), bool)
    at = rows["entry"].iloc[0]
    while not pd.isna(at) and at < first + len(to):
        begins[int(at) - first] = True
        at = to[int(at) - first]
    return rows.drop(columns=["entry"]).assign(begins=begins)


def in_blocks(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], drop: list[str], add: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in drop)
    return rows.groupBy(*keys, "block").applyInPandas(run, f"{schema}, {add}")


def continued(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, pos, need, n_all, n_rest, ...) with _t, the number of the sequence that
    a line belongs to, and _new, whether it begins it. A sequence goes on until it has
    the cells it needs: n_rest of its first line, which a name begins, n_all of others.

    From every line, a step goes to the line after the sequence that it would begin;
    the lines that steps from the first line reach do begin one. Inside a block of
    BLOCK lines a task follows the steps; over the few lines by which blocks are
    entered, pointer jumping does, in as many rounds as the number of blocks has
    binary digits. The work is linear in the lines, in any number of tasks."""
    steps = following(rows, keys).withColumn("block", F.floor((F.col("at") - 1) / BLOCK))
    steps = cut(in_blocks(steps, keys, way_out, [], "out long"))
    doors = steps.select(*keys, F.col("out").alias("at")).distinct().union(steps.filter("at = 1").select(*keys, "at"))
    jump = cut(steps.join(doors, [*keys, "at"]).select(*keys, "at", "out"))
    jump = cut(jump.join(jump.select(*keys, F.col("at").alias("out")), [*keys, "out"], "left_semi").select(*keys, "at", "out"))  # lines there are
    entered = cut(steps.filter("at = 1").select(*keys, "at"))
    while not jump.isEmpty():
        entered = cut(entered.union(entered.join(jump, [*keys, "at"]).select(*keys, F.col("out").alias("at"))).distinct())
        far = jump.select(*keys, F.col("at").alias("out"), F.col("out").alias("_out"))
        jump = cut(jump.join(far, [*keys, "out"]).select(*keys, "at", F.col("_out").alias("out")))
    entry = entered.select(*keys, F.floor((F.col("at") - 1) / BLOCK).alias("block"), F.col("at").alias("entry"))
    lines = in_blocks(steps.drop("out").join(entry, [*keys, "block"], "left"), keys, walked, ["entry"], "begins boolean")
    numbered = running(lines.select(*keys, "pos", "at", "begins"), keys, ["at"], t=F.col("begins").cast("long"))
    return rows.join(numbered.select(*keys, "pos", (F.col("t") - 1).cast("int").alias("_t"), F.col("begins").alias("_new")), [*keys, "pos"])
