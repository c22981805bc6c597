"""Codon substitution models: rate matrices, dN/dS and transition probabilities.

The long forms are DataFrames over the 263 neighbouring codon pairs; the dense
forms are numpy arrays of at most a few hundred states, for the likelihood.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.functions.genetic import NUCLEOTIDES, SENSE, amino_acids, codon_pairs, codons, sense_codons


def rate(pi_to: Column, kappa: Column | float, omega: Column | float) -> Column:
    """pi of the target, times kappa for a transition, times omega for an amino-acid change."""
    kappa, omega = (F.lit(x) if isinstance(x, float) else x for x in (kappa, omega))
    return pi_to * F.when(F.col("is_transition"), kappa).otherwise(F.lit(1.0)) * F.when(F.col("is_synonymous"), F.lit(1.0)).otherwise(omega)


def cumulative_omegas(spark: SparkSession, increments: list[float]) -> DataFrame:
    """regime, omega: running sums of the increments, so regimes are in order of omega."""
    base = spark.createDataFrame(list(enumerate(increments)), "regime int, increment double")
    return base.select("regime", F.sum("increment").over(Window.orderBy("regime")).alias("omega"))  # a row per regime


def rate_matrix(spark: SparkSession, kappa: float, increments: list[float], switching: float = 0.0) -> DataFrame:
    """i, j, rate in long form, uniform codon frequencies. States of regime r are
    61 r .. 61 r + 60; the mean rate is 1 before switching between regimes is added."""
    k, pi = len(increments), 1.0 / SENSE
    pairs = codon_pairs(codons(spark))
    both = pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "codon_j", "codon_i", "is_transition", "is_synonymous"))
    off = both.join(F.broadcast(cumulative_omegas(spark, increments)), F.lit(True)).select(  # a row per regime
        "regime", "i", "j", rate(F.lit(pi), kappa, F.col("omega")).alias("rate")
    )
    rows = off.groupBy("regime", "i").agg(F.sum("rate").alias("out"))
    scale = rows.groupBy().agg((F.lit(float(k)) / (F.sum("out") * pi)).alias("scale"))
    scaled = off.unionByName(rows.select("regime", "i", F.col("i").alias("j"), (-F.col("out")).alias("rate"))).join(F.broadcast(scale), F.lit(True))  # one row
    stay = F.when(F.col("i") == F.col("j"), F.lit((k - 1) * switching)).otherwise(0.0)
    inside = scaled.select((F.col("regime") * SENSE + F.col("i")).alias("i"), (F.col("regime") * SENSE + F.col("j")).alias("j"), (F.col("rate") * F.col("scale") - stay).alias("rate"))
    if k == 1:
        return inside
    state = spark.range(SENSE * k * k).select((F.col("id") % SENSE).cast("int").alias("s"), (F.floor(F.col("id") / SENSE) % k).cast("int").alias("a"), F.floor(F.col("id") / (SENSE * k)).cast("int").alias("b"))
    across = state.filter("a != b").select((F.col("a") * SENSE + F.col("s")).alias("i"), (F.col("b") * SENSE + F.col("s")).alias("j"), F.lit(switching).alias("rate"))
    return inside.union(across)


def raw_dnds(spark: SparkSession, kappa: float, omegas: DataFrame) -> DataFrame:
    """regime, dnds_raw: summed non-synonymous over summed synonymous exchange, not
    divided by mutational opportunity; dnds_per_site divides by its value at omega 1."""
    pairs = codon_pairs(codons(spark)).join(F.broadcast(omegas), F.lit(True))  # a row per regime
    weight = rate(F.lit(2.0 / SENSE), kappa, F.col("omega"))
    neutral = rate(F.lit(2.0 / SENSE), kappa, 1.0)
    syn, non = F.col("is_synonymous"), ~F.col("is_synonymous")
    ratio = F.sum(F.when(non, weight)) / F.sum(F.when(syn, weight))
    return pairs.groupBy("regime").agg(ratio.alias("dnds_raw"), (ratio / (F.sum(F.when(non, neutral)) / F.sum(F.when(syn, neutral)))).alias("dnds_per_site"))


def sampled_omegas(samples: DataFrame) -> DataFrame:
    """(sample, kappa, increments) to (sample, kappa, n, regime, omega): running sums of
    each sample's increments, inside its row."""
    sums = F.transform(F.sequence(F.lit(1), F.size("increments")), lambda k: F.aggregate(F.slice("increments", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    return samples.select("sample", "kappa", F.size("increments").alias("n"), F.posexplode(sums).alias("regime", "omega"))


def sampled_rates(samples: DataFrame, switching: float = 0.0) -> DataFrame:
    """(sample, kappa, increments) to (sample, i, j, rate): the rate matrices of all samples
    of a trace, as rate_matrix has them of one. The pairs of codons go to the samples,
    which stay where they are; rows of a matrix meet in the sums of a sample."""
    spark, pi = samples.sparkSession, 1.0 / SENSE
    pairs = codon_pairs(codons(spark))
    both = pairs.select("i", "j", "is_transition", "is_synonymous").union(pairs.select("j", "i", "is_transition", "is_synonymous"))
    off = sampled_omegas(samples).join(F.broadcast(both), F.lit(True)).select("sample", "n", "regime", "i", "j", rate(F.lit(pi), F.col("kappa"), F.col("omega")).alias("rate"))  # 526 pairs
    out = off.groupBy("sample", "n", "regime", "i").agg(F.sum("rate").alias("rate"))
    scale = out.groupBy("sample").agg((F.first("n") / (F.sum("rate") * pi)).alias("scale"))
    rows = off.unionByName(out.select("sample", "n", "regime", "i", F.col("i").alias("j"), (-F.col("rate")).alias("rate"))).join(scale, "sample")
    stay = F.when(F.col("i") == F.col("j"), (F.col("n") - 1) * switching).otherwise(0.0)
    inside = rows.select("sample", *[(F.col("regime") * SENSE + F.col(x)).alias(x) for x in "ij"], (F.col("rate") * F.col("scale") - stay).alias("rate"))
    moves = samples.select("sample", F.size("increments").alias("n")).select("sample", F.explode(F.sequence(F.lit(0), F.col("n") * SENSE - 1)).alias("i"), "n")
    across = moves.select("sample", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("r")).select("sample", "i", (F.col("r") * SENSE + F.col("i") % SENSE).alias("j"), F.lit(switching).alias("rate"))
    return inside.union(across.filter("i != j"))


def sampled_dnds(samples: DataFrame) -> DataFrame:
    """sample, regime, omega, mean_rate (before scaling), dnds_raw, dnds_per_site for every
    regime of every sample, from the counts of neighbouring pairs by kind."""
    kinds = codon_pairs(codons(samples.sparkSession)).groupBy("is_transition", "is_synonymous").agg((F.count(F.lit(1)) * 2.0 / SENSE).alias("pi"))
    each = sampled_omegas(samples).join(F.broadcast(kinds), F.lit(True))  # four rows
    weight, neutral = (rate(F.col("pi"), F.col("kappa"), o) for o in (F.col("omega"), 1.0))
    syn = F.col("is_synonymous")
    total = lambda w, of: F.sum(F.when(of, w))
    ratio = total(weight, ~syn) / total(weight, syn)
    return each.groupBy("sample", "regime").agg(
        F.first("omega").alias("omega"), (F.sum(weight) / SENSE).alias("mean_rate"), ratio.alias("dnds_raw"), (ratio / (total(neutral, ~syn) / total(neutral, syn))).alias("dnds_per_site")
    )


def tiled_frequencies(frequencies: DataFrame, regimes: int) -> DataFrame:
    """(state, pi) to the stationary frequencies of a model of so many regimes."""
    tiles = frequencies.select(F.explode(F.sequence(F.lit(0), F.lit(regimes - 1))).alias("r"), "state", "pi")
    return tiles.select((F.col("r") * SENSE + F.col("state")).alias("state"), (F.col("pi") / regimes).alias("pi"))


@functools.lru_cache(maxsize=4)
def neighbour_arrays(code: str = "standard") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """from, to, is transition, is synonymous: the pairs in both directions."""
    table, aa = sense_codons(code), amino_acids(code)
    at, found = {c: i for i, c in enumerate(table)}, []
    for c in table:
        for p in range(3):
            for x in NUCLEOTIDES:
                d = c[:p] + x + c[p + 1 :]
                if d != c and d in at:
                    found.append((at[c], at[d], c[p] + x in ("AG", "GA", "CT", "TC"), aa[c] == aa[d]))
    i, j, ts, syn = map(np.array, zip(*found, strict=True))
    return i, j, ts, syn


def dense_rates(kappa: float, omegas: np.ndarray, pi: np.ndarray, switching: float = 0.0) -> np.ndarray:
    """The rate matrix over len(omegas) regimes, mean rate 1 before switching."""
    i, j, ts, syn = neighbour_arrays()
    k, n = len(omegas), len(pi)
    q = np.zeros((k, n, n))
    base = pi[j] * np.where(ts, kappa, 1.0)
    for r, w in enumerate(omegas):
        q[r, i, j] = base * np.where(syn, 1.0, w)
    out = q.sum(axis=2)
    scale = k / (out @ pi).sum()
    full = np.zeros((k * n, k * n))
    for r in range(k):
        full[r * n : r * n + n, r * n : r * n + n] = q[r] * scale - np.diag(out[r] * scale + (k - 1) * switching)
        for s in range(k):
            if s != r:
                full[r * n : r * n + n, s * n : s * n + n] = switching * np.eye(n)
    return full


def exponentials(q: np.ndarray, pi: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """lengths -> exp(q v) for each length v; q is reversible under pi, so it is
    symmetrised, and decomposed once."""
    full = np.tile(pi, len(q) // len(pi)) / (len(q) // len(pi))
    root = np.sqrt(full)
    values, vectors = np.linalg.eigh(q * root[:, None] / root[None, :])
    left, right = vectors / root[:, None], vectors.T * root[None, :]
    return lambda lengths: np.maximum(np.einsum("ik,vk,kj->vij", left, np.exp(np.outer(lengths, values)), right, optimize=True), 0.0)


def transition_matrices(q: np.ndarray, pi: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """exp(q v) for each length v."""
    return exponentials(q, pi)(lengths)


def transition_probabilities(lengths: DataFrame, kappa: float, omegas: list[float], switching: float = 0.0) -> DataFrame:
    """v, i, j, p = exp(Q v)[i, j] for every row's length v, uniform codon frequencies:
    each task makes the matrices of its own lengths, one at a time, and decomposes the
    rate matrix once. Null lengths give no rows."""
    pi = np.full(SENSE, 1.0 / SENSE)
    q = dense_rates(kappa, np.array(omegas), pi, switching)
    n = len(q)

    def matrices(batches):
        i, j = np.repeat(np.arange(n, dtype=np.int32), n), np.tile(np.arange(n, dtype=np.int32), n)
        exponential = exponentials(q, pi)
        for batch in batches:
            for v in batch["v"].dropna():
                yield pd.DataFrame({"v": v, "i": i, "j": j, "p": exponential(np.array([v]))[0].ravel()})

    return lengths.select(F.col("v").cast("double")).mapInPandas(matrices, "v double, i int, j int, p double")
