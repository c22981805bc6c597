"""Operator 3: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.llm.common import BROADCAST_ROWS, cut, fresh, split_join, stable, table, text_of, with_row_id

#: A word: a run without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20240607
#: Most bytes of source names in a table of sources that is broadcast.
BROADCAST_BYTES = 16 << 20
ON = ["_s", "_null"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ranked_sources(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with its weight: by code point of the name,
    null last, the weights repeat. The rank is a range-partitioned sort plus the
    row counts of the partitions before, so no task holds all sources."""
    at = cut(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id())
    ).withColumns({"_part": F.shiftright("_m", 33), "_pos": F.col("_m").bitwiseAND((1 << 33) - 1)})
    before = (
        at.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_k"))
        .withColumn("_before", F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )  # a row for each partition
    n = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_pos") + F.col("_before")) % len(weights) + 1).cast("int"))
    return at.join(F.broadcast(before), "_part").select("source", "source_size", n.alias("weight"))


def water_level(ranked: DataFrame, max_epochs: float = MAX_EPOCHS) -> float:
    """The words per unit of weight at which the targets min(cap, level * weight)
    sum to all words. Each round clamps the sources above their cap and shares the
    rest by weight; only sums reach the driver."""
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * max_epochs
        total, taken, weight = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("source_size") * F.lit(float(max_epochs))).otherwise(0.0)),
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)),
        ).first()
        if not total or not weight:
            return math.inf if total else 0.0
        new = (total - taken) / weight
        if new <= level * (1 + 1e-12):
            return level
        level = new


def join_sources(rows: DataFrame, sources: DataFrame, few: bool, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(sources), on) if few else split_join(rows, sources, on)


def narrowed(docs: DataFrame, at: DataFrame, few: bool, earlier: list[str], digit: str) -> DataFrame:
    """at (source, part, before, and a value of each earlier digit, inside which the cut
    falls) with the value of the next digit inside which it falls."""
    within = [*ON, *earlier]
    sums = join_sources(docs, at, few, within).groupBy(*within, digit).agg(F.sum("size").alias("_size"), F.first("part").alias("part"), F.first("before").alias("_start"))
    up_to = Window.partitionBy(*ON).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("_start") + F.coalesce(F.sum("_size").over(up_to), F.lit(0)))
    return sums.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("_size") >= F.col("part"))).select(*within, digit, "part", "before")


def source_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, bool]:
    """A row per source: source_size, target, whole repetitions, and the last document
    that gets one more (``_edge``, itself included if ``_with``); and whether the
    sources are few enough to be broadcast, which is counted first.

    docs: _rid, source, size, key, _s, _null, _order. Documents of a source stand in
    order of a seeded hash of id and text, copies of a row in that of their number; the
    part of a repetition goes to the first of them, whole, up to the one whose middle
    passes the cut, so a source misses its target by half a document at most. The
    cut is found digit by digit: the range of hashes inside which it falls, the
    hash, the range of row numbers, the row. Each step takes sums over about
    sqrt(n) values a source, so neither a hot source nor a hot row is sorted whole.
    """
    sources = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    n, width = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    few = n < BROADCAST_ROWS and width < BROADCAST_BYTES
    ranked = cut(ranked_sources(sources, weights), n)
    level = water_level(ranked, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    share = F.col("weight") * F.lit(level if math.isfinite(level) else 1e300)
    plan = ranked.withColumn("target", F.when(share >= cap, cap).otherwise(share))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(
        plan.withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("_s", F.coalesce("source", F.lit("")))
        .withColumn("_null", F.col("source").isNull()),
        n,
    )
    bits = max(1, math.ceil(math.log2(max(docs.count(), 1)) / 2))
    ranges = docs.withColumns({
        "_d0": F.shiftright(F.col("_order.key"), 64 - bits), "_d1": F.col("_order.key"), "_d2": F.shiftright(F.col("_order.row"), 64 - bits),
    })
    at, digits = plan.filter("part > 0").select(*ON, "part", F.lit(0).cast("long").alias("before")), []
    for digit in ("_d0", "_d1", "_d2"):
        at = narrowed(ranges, at, few, digits, digit)
        digits.append(digit)
    in_order = Window.partitionBy(*ON).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = join_sources(ranges, at, few, [*ON, *digits]).withColumn("_cum", F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    out = F.min(F.when(F.col("_cum") + F.col("size") / 2 > F.col("part"), F.col("_order")))
    edges = rows.groupBy(*ON).agg(F.coalesce(out, F.max("_order")).alias("_edge"), out.isNull().alias("_with"))
    return cut(plan.join(edges, ON, "left").select(*ON, "source_size", "target", "whole", "_edge", "_with"), n), few


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (source, text, doc_id) with the repetitions the mix takes of each row.

    Returns ``_id``, the columns in ``keep``, size, source_size, target, taken and
    reps. Null or empty text: no words. Very long texts: whole; a document is taken
    whole or not. Null source: a source of its own, last in the order. Null id: as any
    other. Ties (rows of equal id and text) and repeated rows: each row on its own. A
    source without words: target and taken 0. Empty table: empty result. Other
    columns: not read but those in ``keep``. Same rows and seed: same result.
    """
    docs = stable(docs)
    rid, text = fresh(docs, "_rid"), text_of(docs)
    base = with_row_id(docs, rid).select(
        F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("source"), *[F.col(c).alias(f"_k_{c}") for c in keep], word_count(text).alias("size"),
        F.struct(F.xxhash64("doc_id", text, F.lit(seed)).alias("key"), F.xxhash64(F.col(rid), F.lit(seed)).alias("row"), F.col(rid).alias("rid")).alias("_order"),
    ).withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})
    lean = cut(base.drop(*[f"_k_{c}" for c in keep]))
    plan, few = source_plan(lean, weights, max_epochs)
    joined = join_sources(base if keep else lean, plan, few, ON)
    more = F.coalesce((F.col("_order") < F.col("_edge")) | (F.col("_with") & (F.col("_order") == F.col("_edge"))), F.lit(False))
    return joined.withColumn("reps", F.col("whole") + more.cast("long")).select(
        "_id", *[F.col(f"_k_{c}").alias(c) for c in keep], "size", "source_size", "target", (F.col("reps") * F.col("size")).alias("taken"), "reps"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns, whatever
    their names. Nulls, ties, repeated rows and empty tables: as in mix."""
    cols = list(docs.columns)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "doc_id", "source", "text")
    return (
        mix(held, keep=("_row",))
        .filter(F.col("reps") > 0)
        .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))))
        .select(*[F.col("_row").getField(c).alias(c) for c in cols])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")
