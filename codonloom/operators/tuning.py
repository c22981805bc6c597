"""Search of proposal widths: candidates run as chains side by side, scored together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.operators import traces
from codonloom.operators.chains import Chain, Settings
from codonloom.operators.likelihood import tree_arrays

WIDTHS = ("kappa", "omega", "switching", "length", "pi", "shares")


def latin_hypercube(n: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """n points in the unit cube, one in each of n equal slices of every dimension."""
    return (np.stack([rng.permutation(n) for _ in range(dims)], axis=1) + rng.random((n, dims))) / n


def search(columns: DataFrame, tree: DataFrame, settings: Settings, candidates: int = 16, spread: float = 4.0) -> DataFrame:
    """candidate, smooth and the widths tried, best first. Candidates scale the default
    widths by factors from a Latin hypercube in the logarithm; each runs a short chain in
    a task of its own and is scored by smoothed autocorrelation of its parameters."""
    nodes, rng = tree_arrays(tree), np.random.default_rng(settings.seed)
    factors = spread ** (2 * latin_hypercube(candidates, len(WIDTHS), rng) - 1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        c = int(group["chain"].iloc[0])
        masks = np.stack(group.sort_values("site")["masks"].to_numpy())
        chain = Chain(masks, nodes, settings, np.random.default_rng([settings.seed, c]))
        chain.width = {w: chain.width[w] * f for w, f in zip(WIDTHS, factors[c], strict=True)}
        rows = []
        for i in range(settings.iterations):
            chain.step()
            rows += [(i, c, p, v) for p, v in chain.sample().items() if p in ("K", "TreeLength", "Omega0", "Posterior")]
        return pd.DataFrame(rows, columns=["iteration", "chain", "param", "value"])

    keyed = columns.select("site", "masks", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("chain"))
    trace = keyed.groupBy("chain").applyInPandas(run, "iteration long, chain int, param string, value double")
    rows = keyed.select("chain").distinct().withColumn("n", F.lit(settings.iterations))
    scores = traces.smooth_autocorrelation(traces.autocorrelation(trace), rows)
    tried = columns.sparkSession.createDataFrame([(c, *map(float, factors[c])) for c in range(candidates)], "chain int, " + ", ".join(f"{w} double" for w in WIDTHS))
    return scores.join(F.broadcast(tried), "chain").withColumnRenamed("chain", "candidate").orderBy(F.col("smooth").desc())
