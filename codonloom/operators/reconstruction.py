"""Quantities rebuilt from samples: trees, category omegas, ancestral dN/dS."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.genetic import SENSE
from codonloom.functions.substitution import dense_rates, neighbour_arrays, transition_matrices
from codonloom.operators import trees
from codonloom.operators.likelihood import prune, tree_arrays

KEYS = ["replicate", "chain", "iteration"]


def indexed(trace: DataFrame, name: str) -> DataFrame:
    """The parameters ``name[i]`` or ``name[i,j]`` with their indices as columns i and j."""
    first, second = (F.regexp_extract("param", rf"^{name}\[(\d+)(?:,(\d+))?\]$", g).try_cast("int") for g in (1, 2))
    return trace.filter(F.col("param").startswith(f"{name}[")).select(*KEYS, first.alias("i"), second.alias("j"), "value")


def sampled_trees(trace: DataFrame, tree: DataFrame) -> DataFrame:
    """replicate, chain, iteration, newick: the fixed tree with each sample's branches."""
    lengths = indexed(trace, "Branch").select(*KEYS, F.col("i").alias("node_idx"), F.col("value").alias("branch_len"))
    keyed = lengths.withColumn("tree_id", F.struct(*KEYS)).join(F.broadcast(tree.select("node_idx", "parent_idx", "name", "is_tip")), "node_idx")
    return trees.newick(keyed.select("tree_id", "node_idx", "parent_idx", "name", "is_tip", "branch_len")).select("tree_id.*", "newick")


def site_omegas(trace: DataFrame) -> DataFrame:
    """replicate, chain, iteration, site, regime, omega: each site's category's omegas."""
    cats = indexed(trace, "SiteCategory").select(*KEYS, F.col("i").alias("site"), F.col("value").cast("int").alias("cat"))
    omegas = indexed(trace, "CategoryOmega").select(*KEYS, F.col("i").alias("cat"), F.col("j").alias("regime"), F.col("value").alias("omega"))
    return cats.join(omegas, [*KEYS, "cat"]).select(*KEYS, "site", "regime", "omega")


def raw_dnds(pi: np.ndarray, kappa: float, omega: np.ndarray) -> np.ndarray:
    i, j, ts, syn = neighbour_arrays()
    w = np.where(ts, kappa, 1.0) * (pi[i] + pi[j])
    return omega * w[~syn].sum() / w[syn].sum()


def ancestral_dnds(trace: DataFrame, columns: DataFrame, tree: DataFrame, seed: int, block: int = 50) -> DataFrame:
    """replicate, chain, iteration, site, node_idx, dnds: for each sample of an M0 or CMM
    trace, states drawn from root to tips given the data, as dN/dS of their regimes.

    Samples meet the columns of their replicate in blocks; every (sample, block) row is
    independent and has its own generator, so the work spreads over all of them.
    """
    order, parents, _ = tree_arrays(tree)

    def arrays(name: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct("i", "value")))
        return indexed(trace, name).groupBy(*KEYS).agg(F.transform(x, lambda r: r["value"]).alias(name))

    one = trace.filter(F.col("param").isin("K", "R") | F.col("param").rlike("^Omega[0-9]+$")).groupBy(*KEYS).agg(
        F.max(F.when(F.col("param") == "K", F.col("value"))).alias("kappa"), F.max(F.when(F.col("param") == "R", F.col("value"))).alias("switching"),
        F.array_sort(F.collect_list(F.when(F.col("param").startswith("Omega"), F.col("value")))).alias("omegas"),
    )
    samples = one.join(arrays("Pi"), KEYS).join(arrays("Branch"), KEYS)
    blocks = columns.groupBy("replicate", F.floor(F.col("site") / block).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("site", "masks"))).alias("cols"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b.itertuples():
                pi, omegas = np.array(t.Pi), np.array(t.omegas)
                k = len(omegas)
                p = transition_matrices(dense_rates(t.kappa, omegas, pi, t.switching), pi, np.array(t.Branch)[order])
                sites = np.array([c["site"] for c in t.cols])
                partial, _ = prune(np.stack([np.array(c["masks"]) for c in t.cols]), (order, parents, None), p, k)
                u = np.random.default_rng([seed, t.replicate, t.chain, t.iteration, t.block]).random((len(order), len(sites)))
                dnds, states, out = raw_dnds(pi, t.kappa, omegas), {}, []
                for at in range(len(order) - 1, -1, -1):
                    node, parent = int(order[at]), int(parents[at])
                    w = (np.tile(pi, k)[None, :] if parent < 0 else p[at][states[parent]]) * partial[node]
                    cum = np.cumsum(w, axis=1)
                    states[node] = (cum < (u[at] * cum[:, -1])[:, None]).sum(axis=1).clip(max=k * SENSE - 1)
                    out.append(pd.DataFrame({"site": sites, "node_idx": node, "dnds": dnds[states[node] // SENSE]}))
                rows = pd.concat(out)
                for key in KEYS:
                    rows[key] = getattr(t, key)
                yield rows[[*KEYS, "site", "node_idx", "dnds"]]

    return samples.join(blocks, "replicate").mapInPandas(run, "replicate long, chain int, iteration long, site int, node_idx int, dnds double")
