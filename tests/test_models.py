import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.functions import genetic, probability
from codonloom.functions.substitution import dense_rates, neighbour_arrays, rate_matrix, transition_matrices
from codonloom.operators import chains, likelihood, simulation, trees
from codonloom.sources.adapters import codon_cells, tree_nodes

PI = np.random.default_rng(0).dirichlet(np.full(61, 2.0))


def small_tree(spark):
    rows = [(0, 3, "a", True, 0.1), (1, 3, "b", True, 0.2), (2, 4, "c", True, 0.3), (3, 4, None, False, 0.15), (4, None, None, False, 0.0)]
    return spark.createDataFrame(rows, "node_idx int, parent_idx int, name string, is_tip boolean, branch_len double")


def test_static_facts(spark):
    codons = genetic.codons(spark)
    assert codons.count() == 61
    r = genetic.codon_pairs(codons).agg(F.count(F.lit(1)), F.count_if("is_transition"), F.count_if("is_synonymous")).first()
    assert tuple(r) == (263, 89, 67)
    i, j, ts, syn = neighbour_arrays()
    assert (len(i), ts.sum(), (~syn).sum()) == (526, 178, 392)
    assert len(genetic.CHANGES) == 17 and genetic.amino_acids("vertebrate_mitochondrial")["TGA"] == "W"


def test_transition_matrices():
    q = dense_rates(2.0, np.array([0.3, 0.9]), PI, 0.2)
    p = transition_matrices(q, PI, np.array([0.0, 0.3, 50.0]))
    full = np.tile(PI, 2) / 2
    assert np.allclose(p.sum(axis=2), 1) and np.allclose(p[0], np.eye(122), atol=1e-9)
    assert np.allclose(full @ p[1], full) and np.allclose(p[2], full[None, :], atol=1e-3)
    assert np.isclose(-(np.diag(dense_rates(2.0, np.array([0.3]), PI)) @ PI), 1)


def test_long_and_dense_matrices_agree(spark):
    want = dense_rates(2.0, np.array([0.1, 0.5, 1.5]), np.full(61, 1 / 61), 0.2)
    got = np.zeros_like(want)
    for r in rate_matrix(spark, 2.0, [0.1, 0.4, 1.0], 0.2).collect():
        got[r.i, r.j] = r.rate
    assert np.allclose(got, want)


def test_pruning_equals_the_sum_over_inner_states(spark):
    tree = small_tree(spark)
    cells = spark.createDataFrame([(t, s, 1 << st) for s, col in enumerate([(3, 3, 7), (0, 60, 5)]) for t, st in enumerate(col)], "taxon_idx int, site int, mask long")
    q = dense_rates(1.7, np.array([0.4]), PI)
    pa, pb, pc, p3 = (transition_matrices(q, PI, np.array([v]))[0] for v in (0.1, 0.2, 0.3, 0.15))
    got = dict(likelihood.site_log_likelihood(cells, tree, 1.7, [0.4], pi=PI).collect())
    for s, (a, b, c) in enumerate([(3, 3, 7), (0, 60, 5)]):
        want = sum(PI[r] * p3[r, m] * pa[m, a] * pb[m, b] * pc[r, c] for r, m in itertools.product(range(61), range(61)))
        assert math.isclose(got[s], math.log(want), rel_tol=1e-9)


def test_invariances(spark, sf):
    cells, tree = codon_cells(spark, sf).filter("site < 30"), tree_nodes(spark, sf)
    one = dict(likelihood.site_log_likelihood(cells, tree, 2.0, [0.4]).collect())
    same = dict(likelihood.site_log_likelihood(cells, tree, 2.0, [0.4, 0.4], 0.3).collect())
    assert all(math.isclose(one[s], same[s], rel_tol=1e-8) for s in one)  # equal regimes are one
    missing = cells.withColumn("mask", F.lit(genetic.ALL))
    assert all(abs(v) < 1e-9 for v in dict(likelihood.site_log_likelihood(missing, tree, 2.0, [0.4]).collect()).values())
    rooted = trees.reroot(tree.select(F.lit(0).alias("tree_id"), "*"), 27).drop("tree_id")
    moved = dict(likelihood.site_log_likelihood(cells, rooted, 2.0, [0.4]).collect())
    assert all(math.isclose(one[s], moved[s], rel_tol=1e-8) for s in one)


def test_ancestral_states(spark):
    tree = small_tree(spark)
    cells = spark.createDataFrame([(t, s, 1 << 9) for s in range(300) for t in range(3)], "taxon_idx int, site int, mask long")
    a = likelihood.ancestral_states(cells, tree, 1.7, [0.2], 0.0, seed=1, pi=PI)
    assert a.filter("node_idx < 3").select("state").distinct().collect() == [(9,)]
    assert a.filter("node_idx = 4 AND state = 9").count() > 150
    assert sorted(a.collect()) == sorted(likelihood.ancestral_states(cells.repartition(5), tree, 1.7, [0.2], 0.0, seed=1, pi=PI).collect())


def test_simulation(spark):
    truth = simulation.draw_truth(spark, 3, "DPCMM", 5, taxa=8, sites=120).cache()
    assert truth.count() == 3
    states = simulation.simulate(truth, 5).cache()
    assert states.count() == 3 * 120 * 15
    assert sorted(states.collect()) == sorted(simulation.simulate(truth.repartition(3), 5).collect())
    t = simulation.tree_of(truth)
    assert t.filter("is_tip").count() == 24 and trees.traversal(t).filter("depth = 0").count() == 3
    assert simulation.truth_table(truth).count() == 3
    m0 = simulation.draw_truth(spark, 1, "M0", 1, taxa=6, sites=4000)
    pi = np.array(m0.first().pi)
    root = simulation.simulate(m0, 2).filter("node_idx = 10").groupBy("state").count().collect()
    assert abs(np.array([r["count"] / 4000 - pi[r.state] for r in root])).max() < 0.02


def columns(spark, n_sites=2, taxa=3):
    rows = [(0, s, [genetic.ALL] * taxa) for s in range(n_sites)]
    return spark.createDataFrame(rows, "replicate long, site int, masks array<long>")


@pytest.mark.parametrize("model", ["CMM", "DPCMM"])
def test_chain_without_data_samples_its_prior(spark, model):
    s = chains.Settings(model=model, iterations=12_000, burn_in=300, sample_every=3, sample_prior=True, seed=3, gibbs_sites=1)
    t = chains.run_chains(columns(spark), small_tree(spark), s, chains=4).filter("param IN ('OmegaCount', 'K', 'TreeLength', 'R')").toPandas()
    k = t[t.param == "OmegaCount"].value
    share = k.value_counts(normalize=True)
    most = simulation.MOST_REGIMES[model]
    assert all(abs(share.get(float(i), 0) - 1 / most) < 0.06 for i in range(1, most + 1)), share
    assert abs(t[t.param == "K"].value.mean() - 0.2) < 0.03
    assert abs(t[t.param == "TreeLength"].value.mean() - 35) < 3
    r = t[(t.param == "R") & (t.value > 0)].value
    assert abs(r.mean() - 0.2) < 0.04


def test_chain_recovers_and_repeats(spark):
    truth = simulation.draw_truth(spark, 1, "M0", 11, taxa=6, sites=150, mean=3.0, sd=0.5).cache()
    sim = simulation.simulate(truth, 11).filter("node_idx < 6").withColumn("mask", genetic.state_mask(F.col("state"))).select("replicate", "site", F.col("node_idx").alias("taxon_idx"), "mask")
    cols = sim.groupBy("replicate", "site").agg(F.transform(F.array_sort(F.collect_list(F.struct("taxon_idx", "mask"))), lambda x: x["mask"]).alias("masks"))
    tree = simulation.tree_of(truth).drop("tree_id")
    s = chains.Settings(iterations=150, burn_in=250, sample_every=5, seed=2, tree_mean=3.0, tree_sd=0.5, beta=0.7)
    got = chains.run_chains(cols, tree, s, chains=2)
    means = {r.param: r["avg(value)"] for r in got.groupBy("param").avg("value").collect()}
    x = truth.first()
    assert abs(means["Omega0"] - x.omegas[0][0]) < 0.25 * x.omegas[0][0] + 0.05
    assert abs(means["TreeLength"] - sum(x.branch_len)) < 1.2
    assert sorted(got.collect()) == sorted(chains.run_chains(cols.repartition(4), tree, s, chains=2).collect())


def test_moves_and_their_reverses_cancel():
    """Split then merge, and birth then death, at the same place have opposite ratios."""
    rng = np.random.default_rng(4)
    tree = (np.array([0, 1, 2]), np.array([2, 2, -1]), np.zeros(3))
    c = chains.Chain(np.full((2, 2), genetic.ALL), tree, chains.Settings(model="CMM", sample_prior=True), rng)
    seen = 0
    for _ in range(400):
        x = c.state
        y, up = c.regimes(x)
        z, down = c.regimes(y)
        if z.increments.shape == x.increments.shape and np.allclose(z.increments, x.increments) and (x.increments.shape[1] > 1 or y.increments.shape[1] < 2 or z.switching == x.switching):
            assert math.isclose(up, -down, abs_tol=1e-9)
            seen += 1
        c.step()
    assert seen > 5


def test_distributions(spark):
    x = np.array([0.3, 1.0, 2.5, 10.0, 171.0])
    assert np.allclose(probability.ln_gamma_values(x), [math.lgamma(v) for v in x], rtol=1e-10)
    df = spark.createDataFrame([([0.2, 0.3, 0.5],)], "p array<double>")
    assert math.isclose(df.select(probability.dirichlet_ln_pdf(F.col("p"), 2.0)).first()[0], math.lgamma(6) + math.log(0.03), rel_tol=1e-9)


@pytest.mark.parametrize("wrong", [{"beta": 0}, {"beta": 1.5}, {"swap_every": 0}, {"fixed_regimes": -1}, {"model": "CMM", "fixed_regimes": 6}, {"model": "DPCMM", "fixed_regimes": 4}, {"fixed_regimes": 1}, {"model": "M1"}, {"iterations": 0}, {"rate": 0.0}])
def test_settings_that_no_chain_can_have(wrong):
    with pytest.raises(ValueError):
        chains.Settings(**wrong)
    chains.Settings(model="CMM", fixed_regimes=5, beta=0.5)


def test_quantiles_take_few_evaluations(spark, sf):
    from codonloom.plans import model_queries

    calls = 0

    def cdf(v):
        nonlocal calls
        calls += len(v)
        return probability.gamma_share(2.0, 3.0 * v)

    u = np.concatenate([np.linspace(0.001, 0.999, 999), [1e-9, 1 - 1e-9]])
    x = probability.inverse(cdf, 0.0, math.inf)(u)
    assert np.abs(1 - np.exp(-3 * x) * (1 + 3 * x) - u).max() < 1e-14 and calls < 50 * len(u)  # halves alone: 160
    # Rows with the same values share an evaluation: here each row tells how many its batch took.
    rows = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("a"), F.lit(2).alias("b"))
    assert {tuple(r) for r in rows.select("a", probability.vectorised(lambda a, b: a * 10 + len(b), F.col("a"), F.col("b"))).collect()} == {(None, None), (1, 13.0), (2, 23.0), (3, 33.0)}
    assert model_queries.distribution_shares(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_alphas_of_whole_batches(spark):
    """Every expectation its own: solved outside the row-by-row expressions, and right."""
    rows = spark.range(0, 20_001, 1, 2).select((F.col("id") / 100 - 0.5).alias("e")).withColumn("e", F.when(F.col("e") != 7, F.col("e")))
    got = rows.withColumn("alpha", probability.solve_alpha(F.col("e"), 190.0))
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.toPandas()
    inside = found["e"].between(1, 190)
    assert (found["alpha"].notna() == inside).all() and 18_000 < inside.sum() < 19_000
    a = found["alpha"][inside].to_numpy()
    # The last ones need a larger alpha than is sought.
    assert np.abs(a * np.log1p(190.0 / a) - found["e"][inside].to_numpy()).max() < 1e-4


def test_gaps_are_sent_to_the_letters(spark):
    """No letter is shuffled to find its column, whatever Spark would broadcast by itself."""
    from codonloom.operators.characters import gap_characters

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = gap_characters(spark.createDataFrame([(0, "AC-T"), (1, "A-G"), (2, ""), (3, None), (4, "-")], "taxon_idx long, seq string"))
        assert {tuple(r) for r in got.collect()} == {(1, 0, 0), (2, 0, 0), (3, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, 0), (1, 4, 1)}
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
