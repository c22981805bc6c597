"""Running sums in order and tables of ranges, for keys of any size.

A key's rows may lie in any number of tasks: a running sum is taken inside each part of
a range-partitioned sort and moved by the sums of the parts before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonloom.operators.lineage import cut


def running(rows: DataFrame, keys: list[str], order: list[Column | str], fold: str = "sum", **values: Column) -> DataFrame:
    """rows with a column for each of ``values``: its sum (or with fold="max" the largest)
    over the rows of the same keys up to and with this one. ``order`` should tell the
    rows of a key apart; keys are not null."""
    total = {"sum": F.sum, "max": F.max}[fold]
    at = cut(rows.withColumns({f"_x_{n}": c for n, c in values.items()}).orderBy(*keys, *order).withColumn("_m", F.monotonically_increasing_id()))
    at = at.withColumn("_part", F.shiftright("_m", 33))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(*keys, "_part").agg(*[total(f"_x_{n}").alias(f"_s_{n}") for n in values])
    before = parts.select(*keys, "_part", *[total(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in values])
    within = Window.partitionBy(*keys, "_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    both = at.withColumns({f"_x_{n}": total(f"_x_{n}").over(within) for n in values}).join(before, [*keys, "_part"])
    one = (lambda x, b: x + F.coalesce(b, F.lit(0))) if fold == "sum" else F.greatest
    return both.select(*rows.columns, *[one(F.col(f"_x_{n}"), F.col(f"_b_{n}")).alias(n) for n in values])


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose hot keys Spark may split: with a hash of the keys as one more key,
    both sides are shuffled for the join itself, aggregated before or not."""
    key = F.xxhash64(*on).alias("_join")
    return left.select("*", key).join(right.select("*", key), [*on, "_join"], how).drop("_join")


def range_table(cells: DataFrame, keys: list[str], best: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, k, v) with consecutive k to (keys, level, k, v): the best of the values at
    k to k + 2^level - 1, for every level whose range lies inside. log2(n) rows a cell."""
    level, size = 0, 1
    now = cut(cells.select(*keys, "k", "v"))
    found = now.select(*keys, F.lit(0).alias("level"), "k", "v")
    longest = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while 2 * size <= longest:
        far = now.select(*keys, (F.col("k") - size).alias("k"), F.col("v").alias("_v"))
        now = cut(now.join(far, [*keys, "k"]).select(*keys, "k", best(F.col("v"), F.col("_v")).alias("v")))
        level, size = level + 1, size * 2
        found = found.union(now.select(*keys, F.lit(level).alias("level"), "k", "v"))
    return found


def best_of_range(ranges: DataFrame, table: DataFrame, keys: list[str], best: Callable[[Column, Column], Column]) -> DataFrame:
    """ranges (keys, lo, hi, ...) with v, the best value from lo to hi: two rows of the
    table, whatever the range's length."""
    level = F.length(F.bin(F.col("hi") - F.col("lo") + 1)) - 1
    asked = ranges.withColumn("level", level.cast("int"))
    asked = asked.withColumn("_end", F.expr("hi - shiftleft(1L, level) + 1"))
    one = table.select(*keys, "level", F.col("k").alias("lo"), F.col("v").alias("_v1"))
    two = table.select(*keys, "level", F.col("k").alias("_end"), F.col("v").alias("_v2"))
    both = asked.join(one, [*keys, "level", "lo"]).join(two, [*keys, "level", "_end"])
    return both.select(*ranges.columns, best(F.col("_v1"), F.col("_v2")).alias("v"))
