"""Simulated alignments: random trees, parameters from their priors, states down the tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.functions.genetic import SENSE
from codonloom.functions.substitution import dense_rates, transition_matrices

MOST_REGIMES = {"M0": 1, "CMM": 5, "DPCMM": 3}
TRUTH = "replicate long, kappa double, regimes int, switching double, pi array<double>, omegas array<array<double>>, cats array<int>, parent array<int>, branch_len array<double>"


def random_tree(taxa: int, rng: np.random.Generator) -> np.ndarray:
    """Parent of each node (-1 for the root): tips 0 .. taxa - 1, then inner nodes,
    children before parents. Tips join one by one at a uniformly chosen branch."""
    parent = {0: -2, 1: -2, -2: -1}
    new = -3
    for tip in range(2, taxa):
        at = [n for n in parent if parent[n] != -1]
        below = at[int(rng.integers(len(at)))]
        parent[new], parent[below], parent[tip] = parent[below], new, new
        new -= 1
    depth = {}

    def level(n: int) -> int:
        d = 0
        while parent[n] != -1:
            n, d = parent[n], d + 1
        return d

    for n in parent:
        depth[n] = level(n)
    inner = sorted((n for n in parent if n < 0), key=lambda n: (-depth[n], n))
    number = {t: t for t in range(taxa)} | {n: taxa + i for i, n in enumerate(inner)}
    out = np.full(len(parent), -1)
    for n, p in parent.items():
        out[number[n]] = -1 if p == -1 else number[p]
    return out


def chinese_restaurant(n: int, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """Categories of n sites drawn one after the other."""
    cats, sizes = np.zeros(n, dtype=np.int64), []
    for i in range(n):
        w = np.array([*sizes, alpha])
        c = int(rng.choice(len(w), p=w / w.sum()))
        if c == len(sizes):
            sizes.append(0)
        sizes[c] += 1
        cats[i] = c
    return cats


def draw_truth(spark: SparkSession, replicates: int, model: str, seed: int, taxa: int = 25, sites: int = 200, alpha: float = 0.3, rate: float = 5.0, mean: float = 35.0, sd: float = 10.0) -> DataFrame:
    """One row of true parameters and tree for each replicate, seeded by its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b["id"]:
                rng = np.random.default_rng([seed, int(r)])
                k = int(rng.integers(1, MOST_REGIMES[model] + 1))
                cats = chinese_restaurant(sites, alpha, rng) if model == "DPCMM" else np.zeros(sites, dtype=np.int64)
                parent = random_tree(taxa, rng)
                share = rng.gamma(1.0, size=len(parent)) * (parent >= 0)
                length = rng.gamma(mean**2 / sd**2, sd**2 / mean)
                omegas = np.cumsum(rng.exponential(1 / rate, size=(int(cats.max()) + 1, k)), axis=1)
                rows.append((int(r), rng.exponential(1 / rate), k, rng.exponential(1 / rate) if k > 1 else 0.0, rng.dirichlet(np.full(SENSE, 2.0)), omegas.tolist(), cats, parent, share / share.sum() * length))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRUTH.split(", ")])

    return spark.range(replicates).mapInPandas(run, TRUTH)


def simulate(truth: DataFrame, seed: int, block: int = 50) -> DataFrame:
    """replicate, site, node_idx, state, regime for every node. A replicate's sites are
    dealt in blocks, each with a generator of its own, to as many tasks as there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples():
                pi, parent, length = np.array(t.pi), np.array(t.parent), np.array(t.branch_len)
                sites = np.arange(t.lo, t.hi)
                cats, k = np.array(t.cats)[sites], t.regimes
                rng = np.random.default_rng([seed, t.replicate, t.lo])
                u = rng.random((len(parent), len(sites)))
                state = np.zeros((len(parent), len(sites)), dtype=np.int64)
                for c in np.unique(cats):
                    own = np.flatnonzero(cats == c)
                    p = transition_matrices(dense_rates(t.kappa, np.array(t.omegas[c]), pi, t.switching), pi, length)
                    for n in range(len(parent) - 1, -1, -1):
                        w = np.tile(pi, k)[None, :] / k if parent[n] < 0 else p[n][state[parent[n], own]]
                        cum = np.cumsum(np.broadcast_to(w, (len(own), k * SENSE)), axis=1)
                        state[n, own] = (cum < (u[n, own] * cum[:, -1])[:, None]).sum(axis=1).clip(max=k * SENSE - 1)
                node, at = np.divmod(np.arange(state.size), len(sites))
                yield pd.DataFrame({"replicate": t.replicate, "site": sites[at].astype(np.int32), "node_idx": node.astype(np.int32), "state": (state.ravel() % SENSE).astype(np.int32), "regime": (state.ravel() // SENSE).astype(np.int32)})

    n = F.size("cats")
    blocks = truth.select("*", F.explode(F.sequence(F.lit(0), n - 1, F.lit(block))).alias("lo")).withColumn("hi", F.least(F.col("lo") + block, n))
    return blocks.mapInPandas(run, "replicate long, site int, node_idx int, state int, regime int")


def tree_of(truth: DataFrame) -> DataFrame:
    """The simulated trees as (tree_id, node_idx, parent_idx, name, is_tip, branch_len)."""
    t = truth.select(F.col("replicate").alias("tree_id"), F.posexplode(F.arrays_zip("parent", "branch_len")).alias("node_idx", "x"), ((F.size("parent") + 1) / 2).alias("_tips"))
    tip = F.col("node_idx") < F.col("_tips")
    return t.select("tree_id", "node_idx", F.when(F.col("x.parent") >= 0, F.col("x.parent")).alias("parent_idx"), F.when(tip, F.concat(F.lit("Taxon_"), F.col("node_idx"))).alias("name"), tip.alias("is_tip"), F.col("x.branch_len").alias("branch_len"))


def truth_table(truth: DataFrame) -> DataFrame:
    """The true parameters as one flat row a replicate."""
    return truth.select("replicate", "kappa", "regimes", "switching", F.aggregate("branch_len", F.lit(0.0), lambda a, x: a + x).alias("tree_length"), F.size("omegas").alias("categories"), F.array_join(F.transform(F.flatten("omegas"), lambda x: F.format_string("%.6f", x)), ",").alias("omegas"))
