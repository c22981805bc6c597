"""Seeded random queries, which SQL can't express: simulation, chains, reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.operators import chains, likelihood, reconstruction, simulation, tuning
from codonloom.operators import trees as tr
from codonloom.sources.adapters import codon_cells, tree_nodes

SEED = 20240607


def columns(spark, d):
    return likelihood.columns_of(codon_cells(spark, d)).select(F.lit(0).cast("long").alias("replicate"), "site", "masks")


def simulated_truth(spark, d):
    return simulation.truth_table(simulation.draw_truth(spark, 20, "CMM", SEED))


def simulated_alignments(spark, d):
    return simulation.simulate(simulation.draw_truth(spark, 4, "M0", SEED), SEED).filter("node_idx < 25")


def simulated_mixture(spark, d):
    truth = simulation.draw_truth(spark, 4, "DPCMM", SEED, taxa=8, sites=100)
    return simulation.simulate(truth, SEED).groupBy("replicate", "regime").agg(F.count(F.lit(1)).alias("n"))


def random_trees(spark, d):
    return tr.out_degrees(simulation.tree_of(simulation.draw_truth(spark, 20, "M0", SEED)))


def ancestral_states(spark, d):
    return likelihood.ancestral_states(codon_cells(spark, d), tree_nodes(spark, d), 2.0, [0.1, 0.5, 1.5], 0.2, SEED)


def chain_m0(spark, d):
    return chains.run_chains(columns(spark, d), tree_nodes(spark, d), chains.Settings("M0", 20, 10, 5, seed=SEED), chains=4)


def chain_cmm(spark, d):
    return chains.run_chains(columns(spark, d), tree_nodes(spark, d), chains.Settings("CMM", 6, 2, 2, seed=SEED, fixed_regimes=2), chains=2)


def chain_dpcmm(spark, d):
    return chains.run_chains(columns(spark, d), tree_nodes(spark, d), chains.Settings("DPCMM", 6, 2, 2, seed=SEED, fixed_regimes=1, gibbs_sites=2), chains=2)


def prior_regimes(spark, d):
    """Without data, the regimes that a chain visits follow their uniform prior."""
    s = chains.Settings("CMM", 600, 0, 2, sample_prior=True, seed=SEED)
    t = chains.run_chains(columns(spark, d), tree_nodes(spark, d), s, chains=4)
    return t.filter("param = 'OmegaCount'").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def sampled_trees(spark, d):
    return reconstruction.sampled_trees(chain_m0(spark, d), tree_nodes(spark, d))


def ancestral_dnds(spark, d):
    out = reconstruction.ancestral_dnds(chain_m0(spark, d).filter("chain = 0"), columns(spark, d), tree_nodes(spark, d), SEED)
    return out.groupBy("node_idx", "site").agg(F.avg("dnds").alias("mean_dnds"))


def tuned_widths(spark, d):
    return tuning.search(columns(spark, d), tree_nodes(spark, d), chains.Settings("M0", 40, 0, seed=SEED, sample_prior=True), candidates=8)


QUERIES = {
    f.__name__: f
    for f in (
        simulated_truth, simulated_alignments, simulated_mixture, random_trees, ancestral_states, chain_m0, chain_cmm, chain_dpcmm,
        prior_regimes, sampled_trees, ancestral_dnds, tuned_widths,
    )
}
SQL: dict[str, str] = {}
