"""Likelihood of alignment columns on a fixed tree, over partitions of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.genetic import SENSE
from codonloom.functions.substitution import dense_rates, transition_matrices


def tree_arrays(tree: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, parent (-1 for the root) and branch length of one tree, children before
    parents. A fixed tree is part of the model: one row per taxon, small beside the data."""
    rows = {r["node_idx"]: r for r in tree.select("node_idx", "parent_idx", "branch_len").collect()}
    depth: dict[int, int] = {}
    for n in rows:
        path = []
        while n not in depth:
            path.append(n)
            up = rows[n]["parent_idx"]
            if up is None:
                depth[n] = 0
                path.pop()
            else:
                n = up
        for i, m in enumerate(reversed(path), 1):
            depth[m] = depth[n] + i
    order = sorted(rows, key=lambda n: (-depth[n], n))
    return np.array(order), np.array([-1 if rows[n]["parent_idx"] is None else rows[n]["parent_idx"] for n in order]), np.array([rows[n]["branch_len"] for n in order])


def tip_partials(masks: np.ndarray, regimes: int) -> np.ndarray:
    """(column, state): 1 for each state in the mask, in every regime."""
    return np.tile((masks[:, None] >> np.arange(SENSE)) & 1, (1, regimes)).astype(float)


def prune(masks: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, regimes: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Partial likelihoods of every node, (column, state), and the logs taken out of
    them. masks: (column, taxon). Each node's vectors are divided by their largest."""
    order, parents, _ = tree
    partial: dict[int, np.ndarray] = {}
    logs = np.zeros(len(masks))
    for at, (node, parent) in enumerate(zip(order.tolist(), parents.tolist(), strict=True)):
        if node not in partial:
            partial[node] = tip_partials(masks[:, node], regimes)
        else:
            top = partial[node].max(axis=1)
            top = np.where(top > 0, top, 1.0)
            partial[node] = partial[node] / top[:, None]
            logs += np.log(top)
        if parent >= 0:
            up = partial[node] @ p[at].T
            partial[parent] = partial[parent] * up if parent in partial else up
    return partial, logs


def columns_of(cells: DataFrame) -> DataFrame:
    """site, masks: each column's masks in order of taxon."""
    in_order = F.array_sort(F.collect_list(F.struct("taxon_idx", "mask")))
    return cells.groupBy("site").agg(F.transform(in_order, lambda x: x["mask"]).alias("masks"))


def site_log_likelihood(cells: DataFrame, tree: DataFrame, kappa: float, omegas: list[float], switching: float = 0.0, pi: np.ndarray | None = None) -> DataFrame:
    """site, site_lnl under one regime (M0) or several with switching.

    Equal columns are folded first and computed once, and each site joins its
    pattern's value, so a frequent pattern is no long list; the batches of columns that a
    task holds go through the tree as matrix products. The model is the closure:
    matrices of the tree's branches.
    """
    pi = np.full(SENSE, 1.0 / SENSE) if pi is None else pi
    nodes = tree_arrays(tree)
    k = len(omegas)
    p = transition_matrices(dense_rates(kappa, np.array(omegas), pi, switching), pi, nodes[2])
    full = np.tile(pi, k) / k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                partial, logs = prune(np.stack(b["masks"].to_numpy()), nodes, p, k)
                b["lnl"] = np.log(partial[int(nodes[0][-1])] @ full) + logs
                yield b[["masks", "lnl"]]

    columns = columns_of(cells)
    found = columns.select("masks").distinct().mapInPandas(run, "masks array<long>, lnl double")
    return columns.join(found, "masks").select("site", F.col("lnl").alias("site_lnl"))


def ancestral_states(cells: DataFrame, tree: DataFrame, kappa: float, omegas: list[float], switching: float, seed: int, pi: np.ndarray | None = None) -> DataFrame:
    """site, node_idx, state, regime: states of all nodes drawn from root to tips given
    the data. Each column draws from its own generator, seeded by the seed and site."""
    pi = np.full(SENSE, 1.0 / SENSE) if pi is None else pi
    nodes = tree_arrays(tree)
    k = len(omegas)
    p = transition_matrices(dense_rates(kappa, np.array(omegas), pi, switching), pi, nodes[2])
    full = np.tile(pi, k) / k

    def draw(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
        cum = np.cumsum(weights, axis=1)
        return (cum < (u * cum[:, -1])[:, None]).sum(axis=1).clip(max=weights.shape[1] - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, parents, _ = nodes
        for b in batches:
            if not len(b):
                continue
            partial, _ = prune(np.stack(b["masks"].to_numpy()), nodes, p, k)
            u = np.stack([np.random.default_rng([seed, s]).random(len(order)) for s in b["site"]])
            states: dict[int, np.ndarray] = {}
            for at in range(len(order) - 1, -1, -1):
                node, parent = int(order[at]), int(parents[at])
                prior = np.broadcast_to(full, partial[node].shape) if parent < 0 else p[at][states[parent]]
                states[node] = draw(prior * partial[node], u[:, at])
                yield pd.DataFrame({"site": b["site"], "node_idx": node, "state": states[node] % SENSE, "regime": states[node] // SENSE})

    return columns_of(cells).mapInPandas(run, "site int, node_idx int, state int, regime int")
