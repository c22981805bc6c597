"""Operators on long traces: (iteration, chain, param, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonloom.operators.lineage import cut, small
from codonloom.operators.ordered import running

WINDOW = 25


def after_burn_in(trace: DataFrame, share: float) -> DataFrame:
    """Without the first floor(n * share) rows of each chain and parameter. No task holds a series."""
    placed = running(trace, ["chain", "param"], ["iteration"], _r=F.lit(1).cast("long"))
    sizes = small(cut(trace.groupBy("chain", "param").agg(F.count(F.lit(1)).alias("_n"))))
    return placed.join(sizes, ["chain", "param"]).filter(F.col("_r") > F.floor(F.col("_n") * share)).select(*trace.columns)


def running_best(trace: DataFrame) -> DataFrame:
    """chain, iteration, best: the largest value of a chain so far."""
    rows = trace.groupBy("chain", "iteration").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    best = running(rows, ["chain"], ["iteration"], "max", best=F.col("value"))
    return best.select("chain", "iteration", "best", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")).drop("_k")


def projected(trace: DataFrame, pattern: str) -> DataFrame:
    """The parameters whose whole name the pattern fits, with its two groups as name and site:
    ``^([0-9]+)\\[([0-9]+)\\]$`` for nodes, for example."""
    fits = trace.filter(F.col("param").rlike(pattern))
    return fits.withColumns({"name": F.regexp_extract("param", pattern, 1), "site": F.regexp_extract("param", pattern, 2).cast("int")})


def some_params(trace: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of n parameters drawn by a seeded hash of their names, so reruns agree."""
    names = trace.select("param").distinct().orderBy(F.xxhash64("param", F.lit(seed)), "param").limit(n)
    return trace.join(small(cut(names)), "param", "left_semi")


def thin(trace: DataFrame, every: int) -> DataFrame:
    return trace.filter(F.col("iteration") % every == 0)


def summary(trace: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, population variance, least and largest value by the keys."""
    return trace.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def density(trace: DataFrame, bins: int, low: float, high: float, *keys: str) -> DataFrame:
    """Counts and densities of values in equal bins of [low, high)."""
    width = (high - low) / bins
    inside = trace.filter((F.col("value") >= low) & (F.col("value") < high)).withColumn("bin", F.floor((F.col("value") - low) / width).cast("int"))
    counts = inside.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") / (total * width))


def wide(trace: DataFrame, params: list[str]) -> DataFrame:
    """iteration, chain and a column for each listed parameter: one pivot with known values."""
    return trace.groupBy("iteration", "chain").pivot("param", params).agg(F.first("value"))


def acceptance_rates(proposals: DataFrame, *keys: str) -> DataFrame:
    """Accepted over proposed, null without proposals."""
    return proposals.groupBy(*keys).agg(
        F.count_if("accepted").alias("n_accepted"), F.count(F.lit(1)).alias("n_proposed"), F.avg(F.col("accepted").cast("double")).alias("rate")
    )


def window_scores(series: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of series for each window of aligned series, the first at row ``window``."""
    rows = max((len(x) for x in series), default=0) - window + 1
    if rows < 1:
        return np.zeros(0), np.zeros(0, dtype=np.int64)
    products, variance, count = np.zeros((rows, window - 1)), np.zeros(rows), np.zeros(rows, dtype=np.int64)
    for x in series:
        n = len(x) - window + 1
        if n < 1:
            continue
        w = np.lib.stride_tricks.sliding_window_view(x, window)
        d = w - w.mean(axis=1, keepdims=True)
        variance[:n] += (d**2).mean(axis=1)
        count[:n] += 1
        for k in range(1, window):
            products[:n, k - 1] += (d[:, :-k] * d[:, k:]).sum(axis=1)
    scale = variance[:, None] * np.arange(window - 1, 0, -1)
    share = np.abs(np.divide(products, scale, out=np.zeros_like(products), where=scale > 0))
    return 2.0 - share.sum(axis=1) / window, count


def ranked(trace: DataFrame) -> DataFrame:
    """chain, param, pos, value: the rows of each series numbered from 1 by iteration,
    nulls left out. One range-partitioned sort; a row's number is its place in its
    partition plus the series' rows in the partitions before, so no task holds a series."""
    known = trace.filter(F.col("value").isNotNull()).select("chain", "param", "iteration", "value")
    return running(known, ["chain", "param"], ["iteration"], pos=F.lit(1).cast("long")).select("chain", "param", "pos", "value")


def autocorrelation(trace: DataFrame, window: int = WINDOW, block: int = 1024) -> DataFrame:
    """chain, pos, score over the last ``window`` rows of all parameters of a chain.

    For each lag, the products of deviations summed over rows and parameters, over
    (window - lag) times the summed variances; the absolute values add up to s, and
    the score is 2 - s / window. Rows of a chain's parameters align by rank. A chain of
    any length is scored in blocks of ``block`` windows; the window - 1 rows before a
    block belong to it as well.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("pos", kind="stable")
        score, count = window_scores([x.to_numpy(float) for _, x in ordered.groupby("param")["value"]], window)
        chain, first = group["chain"].iloc[0], int(ordered["pos"].iloc[0])
        return pd.DataFrame({"chain": int(chain), "pos": np.arange(len(score)) + first + window - 1, "score": score, "n_params": count})

    last = F.floor((F.col("pos") + (window - 2)) / block)
    blocks = F.explode(F.sequence(F.floor((F.col("pos") - 1) / block), last)).alias("block")
    return ranked(trace).select("chain", "param", "pos", "value", blocks).groupBy("chain", "block").applyInPandas(run, "chain int, pos int, score double, n_params int")


def smooth_autocorrelation(scores: DataFrame, rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """chain, smooth: the sum of all window scores but the last, over rows - window + 1.
    rows: chain, n (rows of a chain)."""
    joined = scores.join(rows, "chain").filter((F.col("pos") < F.col("n")) & (F.col("n") >= window))
    return joined.groupBy("chain").agg((F.sum("score") / (F.first("n") - (window - 1))).alias("smooth"))


def draw(weights: DataFrame, u: Column, *keys: str) -> DataFrame:
    """For each key the first index whose running share of the weights exceeds u."""
    w = Window.partitionBy(*keys)
    cum = weights.select("*", (F.sum("weight").over(w.orderBy("idx")) / F.sum("weight").over(w)).alias("_c"))
    return cum.filter(F.col("_c") > u).groupBy(*keys).agg(F.min("idx").alias("drawn"))


def best(samples: DataFrame, n: int, score: str = "value") -> DataFrame:
    """The n samples of highest score."""
    return samples.orderBy(F.col(score).desc(), "iteration").limit(n)


def normalised_weights(logs: DataFrame, *keys: str) -> DataFrame:
    """exp(x - max) over its sum within the keys: weights from log weights."""
    w = Window.partitionBy(*keys)
    e = logs.withColumn("_e", F.exp(F.col("ln_weight") - F.max("ln_weight").over(w)))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")
