"""Queries on substitution models and likelihoods, with the DuckDB SQL of the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from codonloom.functions import probability as pr
from codonloom.functions import substitution as sub
from codonloom.functions.genetic import SENSE, codon_pairs, codons
from codonloom.operators import likelihood
from codonloom.operators.characters import step_matrix
from codonloom.operators.step_types import weighted_changes
from codonloom.operators.traces import normalised_weights
from codonloom.sources.adapters import codon_cells, read, tree_nodes, with_sql

KAPPA, OMEGA, INCREMENTS, SWITCH = 2.0, 0.4, [0.1, 0.4, 1.0], 0.2


def q_matrix_m0(spark, d):
    return sub.rate_matrix(spark, KAPPA, [OMEGA]).select("i", "j", F.round("rate", 9).alias("rate"))


def q_matrix_cmm(spark, d):
    return sub.rate_matrix(spark, KAPPA, INCREMENTS, SWITCH).select("i", "j", F.round("rate", 9).alias("rate"))


def stationary_tiled(spark, d):
    k = len(INCREMENTS)
    return spark.range(SENSE * k).select(F.col("id").cast("int").alias("state"), F.round(F.lit(1.0 / SENSE / k), 9).alias("pi"))


def dnds_raw(spark, d):
    return sub.raw_dnds(spark, KAPPA, sub.cumulative_omegas(spark, INCREMENTS)).select("regime", F.round("dnds_raw", 9).alias("dnds_raw"), F.round("dnds_per_site", 9).alias("dnds_per_site"))


def cumulative_omegas(spark, d):
    return sub.cumulative_omegas(spark, INCREMENTS).select("regime", F.round("omega", 9).alias("omega"))


def samples(spark, d):
    """A sample of parameters for each user's events: kappa and three increments of omega."""
    x = read(spark, d, "events").filter("value IS NOT NULL").groupBy(F.col("user_id").alias("sample")).agg(F.round(F.avg(F.abs("value")), 3).alias("m"), F.count(F.lit(1)).alias("n"))
    return x.select("sample", (1.0 + F.col("m") / 50.0).alias("kappa"), F.array(F.lit(0.1), F.col("m") / 500.0, F.col("n") / 10.0).alias("increments"))


def sampled_rates(spark, d):
    """The diagonal of every sample's rate matrix, and the sum of each row."""
    q = sub.sampled_rates(samples(spark, d), SWITCH)
    out = F.sum(F.when(F.col("i") == F.col("j"), F.col("rate")))
    return q.groupBy("sample", "i").agg(F.round(out, 6).alias("diagonal"), F.round(F.sum(F.when(F.col("i") != F.col("j"), F.col("rate"))), 6).alias("off_diagonal"), F.count(F.lit(1)).alias("n_cells"))


def sampled_dnds(spark, d):
    got = sub.sampled_dnds(samples(spark, d))
    return got.select("sample", "regime", *[F.round(c, 6).alias(c) for c in ("omega", "mean_rate", "dnds_raw", "dnds_per_site")])


def observed_frequencies(spark, d):
    """The frequencies of observed codons as those of a model of three regimes."""
    n = codon_cells(spark, d).filter("state IS NOT NULL").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return sub.tiled_frequencies(n.join(F.broadcast(total), F.lit(True)).select("state", (F.col("n") / F.col("t")).alias("pi")), 3).select("state", F.round("pi", 9).alias("pi"))  # one row


def codon_changes(spark, d):
    """Between each two taxa the sites that differ by one nucleotide, by kind of change."""
    cells = codon_cells(spark, d).filter("state IS NOT NULL")
    a = cells.select("site", F.col("taxon_idx").alias("taxon_a"), F.col("state").alias("_a"))
    b = cells.select("site", F.col("taxon_idx").alias("taxon_b"), F.col("state").alias("_b"))
    both = a.join(b, "site").filter("taxon_a < taxon_b AND _a != _b").select("taxon_a", "taxon_b", F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"))
    counted = both.groupBy("taxon_a", "taxon_b", "i", "j").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(codon_pairs(codons(spark))), ["i", "j"], "left")  # 263 pairs
    kind = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counted.groupBy("taxon_a", "taxon_b").agg(
        F.sum("n").alias("n_changed"), kind(F.col("codon_i").isNotNull()).alias("n_neighbours"), kind(F.col("is_transition")).alias("n_transitions"), kind(F.col("is_synonymous")).alias("n_synonymous")
    )


def ordered_changes(spark, d):
    """Changes between each two taxa under ordered and unordered steps of amino acids' states."""
    cells = codon_cells(spark, d).select("taxon_idx", "site", (F.col("state") % 5).alias("state"))
    got = [weighted_changes(cells, step_matrix(5, o, spark).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("steps").cast("double").alias("steps"))) for o in (True, False)]
    return got[0].select("taxon_a", "taxon_b", "n_sites", F.col("steps").alias("ordered")).join(got[1].select("taxon_a", "taxon_b", F.col("steps").alias("unordered")), ["taxon_a", "taxon_b"])


def transition_prob(spark, d):
    lengths = spark.createDataFrame([(0.1,), (0.3,)], "v double")
    return sub.transition_probabilities(lengths, KAPPA, [OMEGA]).withColumn("p", F.round("p", 8))


def branch_transition_prob(spark, d):
    """Staying and moving away on every branch of the tree, by codon at its start."""
    branches = tree_nodes(spark, d).filter("parent_idx IS NOT NULL").select("node_idx", F.round("branch_len", 6).alias("v"))
    p = sub.transition_probabilities(branches.select("v").distinct(), KAPPA, [OMEGA])
    stay = p.groupBy("v", "i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("p"))).alias("stay"), F.max(F.when(F.col("i") != F.col("j"), F.col("p"))).alias("likeliest_move"))
    return branches.join(stay, "v").select("node_idx", "i", F.round("stay", 8).alias("stay"), F.round("likeliest_move", 8).alias("likeliest_move"))


def site_log_likelihood(spark, d):
    out = likelihood.site_log_likelihood(codon_cells(spark, d), tree_nodes(spark, d), KAPPA, [OMEGA])
    return out.select("site", F.round("site_lnl", 6).alias("site_lnl"))


def total_log_likelihood(spark, d):
    out = likelihood.site_log_likelihood(codon_cells(spark, d), tree_nodes(spark, d), KAPPA, [OMEGA])
    return out.agg(F.round(F.sum("site_lnl"), 4).alias("lnl"), F.count(F.lit(1)).alias("n_sites"))


def site_log_likelihood_cmm(spark, d):
    out = likelihood.site_log_likelihood(codon_cells(spark, d), tree_nodes(spark, d), KAPPA, [0.1, 0.5, 1.5], SWITCH)
    return out.select("site", F.round("site_lnl", 6).alias("site_lnl"))


def log_prior_m0(spark, d):
    """Priors of kappa, omega, tree length and uniform frequencies, for states read from the events."""
    x = read(spark, d, "events").select("event_id", (F.abs("value") / 100 + 0.01).alias("kappa"), (F.abs("value") / 300 + 0.01).alias("omega"), (F.abs("value") / 10 + 1).alias("tree_length"))
    shape, rate = 35.0**2 / 10.0**2, 35.0 / 10.0**2
    pi = math.lgamma(2.0 * SENSE) - SENSE * math.lgamma(2.0) - SENSE * math.log(SENSE)
    total = pr.exponential_ln_pdf(F.col("kappa"), 5.0) + pr.exponential_ln_pdf(F.col("omega"), 5.0) + pr.gamma_ln_pdf(F.col("tree_length"), shape, rate) + F.lit(pi)
    return x.select("event_id", F.round(total, 6).alias("ln_prior"))


def crp_alpha_expected(spark, d):
    alpha = F.col("p_partkey") / 100.0
    return read(spark, d, "part").filter("p_partkey > 0").select("p_partkey", F.round(alpha * F.log1p(200.0 / alpha), 6).alias("expected"))


def crp_alpha_solved(spark, d):
    """Expected categories at the solved concentration: what was asked for."""
    alpha = pr.solve_alpha(F.lit(1.5) + F.col("p_size") % 5, 200.0)
    return read(spark, d, "part").select("p_partkey", F.round(pr.expected_categories(alpha, 200.0), 4).alias("expected"))


def assignments(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("site"), (F.col("c_nationkey") % 6).alias("cat"))


def category_sizes(spark, d):
    return assignments(spark, d).groupBy("cat").agg(F.count(F.lit(1)).alias("n_sites"))


def crp_log_prior(spark, d):
    """K ln alpha + sum of ln gamma(n) over the categories, alpha 0.5."""
    sizes = category_sizes(spark, d)
    return sizes.agg(F.round(F.count(F.lit(1)) * math.log(0.5) + F.sum(pr.ln_gamma(F.col("n_sites"))), 5).alias("ln_prior"))


def site_category_omegas(spark, d):
    omegas = spark.createDataFrame([(c, r, round(0.1 * (c + 1) * (r + 1), 6)) for c in range(6) for r in range(3)], "cat int, regime int, omega double")
    return assignments(spark, d).join(F.broadcast(omegas), "cat").groupBy("site", "cat").pivot("regime", [0, 1, 2]).agg(F.first("omega")).select(
        "site", "cat", *[F.col(str(r)).alias(f"omega{r}") for r in range(3)]
    )


def gibbs_weights(spark, d):
    """Category weights of a Gibbs step from log weights: largest subtracted, exponential, normalised."""
    e = read(spark, d, "events").select("user_id", "event_id", (-F.abs("value")).alias("ln_weight"))
    return normalised_weights(e, "user_id").select("user_id", "event_id", F.round("weight", 8).alias("weight"))


def distribution_shares(spark, d):
    """Densities, cumulated chances and quantiles at the sizes of parts."""
    x = F.col("p_size") / 60.0
    out = {
        "gamma_pdf": pr.gamma_pdf(x, 2.0, 3.0), "gamma_cdf": pr.gamma_cdf(x, 2.0, 3.0), "gamma_back": pr.gamma_cdf(pr.gamma_quantile(x, 2.0, 3.0), 2.0, 3.0),
        "beta_pdf": pr.beta_pdf(x, 2.0, 3.0), "beta_cdf": pr.beta_cdf(x, 2.0, 3.0), "beta_back": pr.beta_cdf(pr.beta_quantile(x, 2.0, 3.0), 2.0, 3.0),
        "chi_pdf": pr.chi_square_pdf(x, 4.0), "chi_cdf": pr.chi_square_cdf(x, 4.0), "chi_back": pr.chi_square_cdf(pr.chi_square_quantile(x, 4.0), 4.0),
        "normal_pdf": pr.normal_pdf(x, 0.5, 0.2), "normal_sum": pr.normal_cdf(x, 0.5, 0.2) + pr.normal_cdf(1.0 - x, 0.5, 0.2), "normal_back": pr.normal_cdf(pr.normal_quantile(x, 0.5, 0.2), 0.5, 0.2),
        "uniform_pdf": pr.uniform_pdf(x, 0.2, 0.7), "uniform_cdf": pr.uniform_cdf(x, 0.2, 0.7), "uniform_quantile": pr.uniform_quantile(x, 0.2, 0.7), "exp_pdf": pr.exponential_pdf(x, 5.0),
        "geometric_pdf": pr.geometric_pdf(F.col("p_size"), 0.1), "geometric_cdf": pr.geometric_cdf(F.col("p_size"), 0.1), "dirichlet_pdf": pr.dirichlet_pdf(F.array(x, 1.0 - x), 2.0),
    }
    # Much work for a row of a small file: more tasks than the file's own.
    part = read(spark, d, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return part.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in out.items()], pr.geometric_quantile(F.col("p_size") / 61.0, 0.1).alias("geometric_quantile"))


def distribution_values(spark, d):
    x = F.col("p_size") / 60.0
    return read(spark, d, "part").select(
        "p_partkey", F.round(pr.beta_ln_pdf(x, 5.0, 5.0), 6).alias("beta"), F.round(pr.gamma_ln_pdf(x, 2.0, 3.0), 6).alias("gamma"),
        F.round(pr.normal_ln_pdf(x, 0.5, 0.2), 6).alias("normal"), F.round(pr.exponential_cdf(x, 5.0), 6).alias("exp_cdf"),
        F.round(pr.exponential_quantile(x, 5.0), 6).alias("exp_quantile"), F.round(pr.ln_gamma(F.col("p_size") / 2.0), 6).alias("ln_gamma"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        q_matrix_m0, q_matrix_cmm, stationary_tiled, dnds_raw, cumulative_omegas, sampled_rates, sampled_dnds, observed_frequencies, codon_changes, ordered_changes, transition_prob, branch_transition_prob, site_log_likelihood, total_log_likelihood,
        site_log_likelihood_cmm, log_prior_m0, crp_alpha_expected, crp_alpha_solved, category_sizes, crp_log_prior, site_category_omegas, gibbs_weights,
        distribution_values, distribution_shares,
    )
}

_D = "CAST({} AS DOUBLE)".format
_BOTH = """,
nb AS (SELECT i, j, is_transition, is_synonymous FROM codon_pairs UNION ALL SELECT j, i, is_transition, is_synonymous FROM codon_pairs)"""
_M0 = _BOTH + f""",
q0 AS (SELECT i, j, {_D("1.0")} / 61 * CASE WHEN is_transition THEN {_D("2.0")} ELSE {_D("1.0")} END * CASE WHEN is_synonymous THEN {_D("1.0")} ELSE {_D("0.4")} END r FROM nb),
ro AS (SELECT i, sum(r) o FROM q0 GROUP BY i),
sc AS (SELECT {_D("1.0")} / (sum(o) / 61) s FROM ro),
q AS (SELECT i, j, r * s rate FROM q0, sc UNION ALL SELECT i, i, -o * s FROM ro, sc)"""
_OMEGAS = f"""om(regime, omega) AS (VALUES (0, {_D("0.1")}), (1, {_D("0.5")}), (2, {_D("1.5")}))"""
_CMM = _BOTH + f""",
{_OMEGAS},
q0 AS (SELECT regime, i, j, {_D("1.0")} / 61 * CASE WHEN is_transition THEN {_D("2.0")} ELSE {_D("1.0")} END * CASE WHEN is_synonymous THEN {_D("1.0")} ELSE omega END r FROM nb, om),
ro AS (SELECT regime, i, sum(r) o FROM q0 GROUP BY regime, i),
sc AS (SELECT {_D("3.0")} / (sum(o) / 61) s FROM ro),
q AS (SELECT CAST(61*regime + i AS INT) i, CAST(61*regime + j AS INT) j, r * s rate FROM q0, sc
  UNION ALL SELECT 61*regime + i, 61*regime + i, -o * s - {_D("0.4")} FROM ro, sc
  UNION ALL SELECT 61*a.regime + c.state, 61*b.regime + c.state, {_D("0.2")} FROM om a, om b, codons c WHERE a.regime <> b.regime)"""
# Transition probabilities by uniformisation: Poisson-weighted powers of I + Q / mu.
_POWERS = """,
mu AS (SELECT max(-rate) m FROM q WHERE i = j),
u AS (SELECT q.i, q.j, CASE WHEN q.i = q.j THEN 1 ELSE 0 END + q.rate / mu.m r FROM q, mu),
pw AS (SELECT 0 k, state i, state j, CAST(1.0 AS DOUBLE) p FROM codons
  UNION ALL SELECT pw.k + 1, pw.i, u.j, sum(pw.p * u.r) FROM pw JOIN u ON pw.j = u.i WHERE pw.k < 24 GROUP BY pw.k + 1, pw.i, u.j)"""
_P = """,
pv AS (SELECT b.v, pw.i, pw.j, sum(exp(-mu.m * b.v + pw.k * ln(mu.m * b.v) - lgamma(pw.k + 1)) * pw.p) p FROM pw, mu, vs b GROUP BY b.v, pw.i, pw.j)"""
_STATES = """,
states AS (SELECT CAST(61*regime + state AS INT) state FROM codons, om)"""
_LIK = """,
vs AS (SELECT DISTINCT branch_len v FROM tree_nodes WHERE parent_idx IS NOT NULL)""" + _P + """,
tipl AS (SELECT c.site, t.parent_idx region, pv.i, exp(sum(ln(pv.p))) l FROM codon_cells c JOIN tree_nodes t ON t.node_idx = c.taxon_idx AND t.is_tip
  JOIN pv ON pv.v = t.branch_len AND pv.j = c.state WHERE c.state IS NOT NULL GROUP BY c.site, t.parent_idx, pv.i),
full_ AS (SELECT s.site, r.node_idx region, r.branch_len v, c.state i, coalesce(x.l, 1.0) l FROM (SELECT DISTINCT site FROM codon_cells) s
  CROSS JOIN (SELECT * FROM tree_nodes WHERE parent_idx = 30) r CROSS JOIN codons c LEFT JOIN tipl x ON x.site = s.site AND x.region = r.node_idx AND x.i = c.state),
regl AS (SELECT f.site, f.region, pv.i, sum(pv.p * f.l) l FROM full_ f JOIN pv ON pv.v = f.v AND pv.j = f.i GROUP BY f.site, f.region, pv.i),
rootl AS (SELECT site, i, exp(sum(ln(l))) l FROM regl GROUP BY site, i),
lnl AS (SELECT site, ln(sum(l) / 61) site_lnl FROM rootl GROUP BY site)"""
# The same over three regimes: a codon may be in any of them.
_POWERS_CMM = _STATES + _POWERS.replace("FROM codons", "FROM states")
_LIK_CMM = (
    _LIK.replace("""tipl AS (""", """tp AS (SELECT v, i, j % 61 j, sum(p) p FROM pv GROUP BY v, i, j % 61),
tipl AS (""", 1).replace("exp(sum(ln(pv.p))) l FROM codon_cells", "exp(sum(ln(tp.p))) l FROM codon_cells").replace("JOIN pv ON pv.v = t.branch_len AND pv.j = c.state WHERE", "JOIN tp ON tp.v = t.branch_len AND tp.j = c.state WHERE")
    .replace("c.site, t.parent_idx region, pv.i", "c.site, t.parent_idx region, tp.i").replace("GROUP BY c.site, t.parent_idx, pv.i)", "GROUP BY c.site, t.parent_idx, tp.i)")
    .replace("CROSS JOIN codons c", "CROSS JOIN states c").replace("ln(sum(l) / 61)", "ln(sum(l) / 183)")
)
_RATES = with_sql("codons", "codon_pairs")
_SAMPLES = f""",
ev AS (SELECT user_id AS sample, round(avg(abs(value)), 3) m, count(*) n FROM events WHERE value IS NOT NULL GROUP BY user_id),
sm AS (SELECT sample, 1 + m / 50 kappa, r.range AS regime, CASE WHEN r.range = 0 THEN {_D("0.1")} WHEN r.range = 1 THEN {_D("0.1")} + m / 500 ELSE {_D("0.1")} + m / 500 + n / {_D("10.0")} END omega FROM ev, range(3) r)"""

SQL = {
    "q_matrix_m0": _RATES + _M0 + " SELECT i, j, round(rate, 9) rate FROM q",
    "q_matrix_cmm": _RATES + _CMM + " SELECT i, j, round(rate, 9) rate FROM q",
    "stationary_tiled": f"SELECT CAST(range AS INT) state, round({_D('1.0')} / 61 / 3, 9) pi FROM range(183)",
    "dnds_raw": _RATES + f""", {_OMEGAS},
      w AS (SELECT regime, is_synonymous, CASE WHEN is_transition THEN {_D("2.0")} ELSE {_D("1.0")} END b, omega FROM codon_pairs, om),
      s AS (SELECT regime, sum(b * omega) FILTER (WHERE NOT is_synonymous) n, sum(b) FILTER (WHERE is_synonymous) y, sum(b) FILTER (WHERE NOT is_synonymous) n1 FROM w GROUP BY regime)
      SELECT regime, round(n / y, 9) dnds_raw, round((n / y) / (n1 / y), 9) dnds_per_site FROM s""",
    "cumulative_omegas": f"WITH {_OMEGAS} SELECT regime, round(omega, 9) omega FROM om",
    "sampled_rates": _RATES + _BOTH + _SAMPLES + f""",
      q0 AS (SELECT sample, regime, i, {_D("1.0")} / 61 * CASE WHEN is_transition THEN kappa ELSE 1 END * CASE WHEN is_synonymous THEN 1 ELSE omega END r FROM nb, sm),
      ro AS (SELECT sample, regime, i, sum(r) o, count(*) n FROM q0 GROUP BY sample, regime, i),
      sc AS (SELECT sample, {_D("3.0")} / (sum(o) / 61) s FROM ro GROUP BY sample)
      SELECT sample, CAST(61 * regime + i AS INT) i, round(-o * s - {_D("0.4")}, 6) diagonal, round(o * s + {_D("0.4")}, 6) off_diagonal, n + 3 n_cells FROM ro JOIN sc USING (sample)""",
    "sampled_dnds": _RATES + _SAMPLES + f""",
      w AS (SELECT sample, regime, omega, is_synonymous syn, {_D("2.0")} / 61 * CASE WHEN is_transition THEN kappa ELSE 1 END b FROM codon_pairs, sm),
      s AS (SELECT sample, regime, omega, sum(b * omega) FILTER (WHERE NOT syn) n, sum(b) FILTER (WHERE syn) y, sum(b) FILTER (WHERE NOT syn) n1 FROM w GROUP BY sample, regime, omega)
      SELECT sample, regime, round(omega, 6) omega, round((n + y) / 61, 6) mean_rate, round(n / y, 6) dnds_raw, round((n / y) / (n1 / y), 6) dnds_per_site FROM s""",
    "observed_frequencies": with_sql("codon_cells") + f"""
      SELECT CAST(61 * r.range + state AS INT) state, round(count(*) / CAST((SELECT count(state) FROM codon_cells) AS DOUBLE) / 3, 9) pi FROM codon_cells, range(3) r WHERE state IS NOT NULL GROUP BY r.range, state""",
    "codon_changes": with_sql("codons", "codon_pairs", "codon_cells") + """
      SELECT a.taxon_idx taxon_a, b.taxon_idx taxon_b, count(*) n_changed, count(p.i) n_neighbours, count(*) FILTER (WHERE is_transition) n_transitions, count(*) FILTER (WHERE is_synonymous) n_synonymous
      FROM codon_cells a JOIN codon_cells b ON a.site = b.site AND a.taxon_idx < b.taxon_idx AND a.state <> b.state LEFT JOIN codon_pairs p ON p.i = least(a.state, b.state) AND p.j = greatest(a.state, b.state)
      GROUP BY a.taxon_idx, b.taxon_idx""",
    "ordered_changes": with_sql("codon_cells") + """
      SELECT a.taxon_idx taxon_a, b.taxon_idx taxon_b, count(*) n_sites, CAST(sum(abs(a.state % 5 - b.state % 5)) AS DOUBLE) ordered, CAST(sum(CASE WHEN a.state % 5 <> b.state % 5 THEN 1 ELSE 0 END) AS DOUBLE) unordered
      FROM codon_cells a JOIN codon_cells b ON a.site = b.site AND a.taxon_idx < b.taxon_idx WHERE a.state IS NOT NULL AND b.state IS NOT NULL GROUP BY a.taxon_idx, b.taxon_idx""",
    "transition_prob": _RATES + _M0 + _POWERS + f", vs(v) AS (VALUES ({_D('0.1')}), ({_D('0.3')}))" + _P + " SELECT v, i, j, round(p, 8) p FROM pv",
    "site_log_likelihood": with_sql("codons", "codon_pairs", "codon_cells", "tree_nodes") + _M0 + _POWERS + _LIK + " SELECT site, round(site_lnl, 6) site_lnl FROM lnl",
    "total_log_likelihood": with_sql("codons", "codon_pairs", "codon_cells", "tree_nodes") + _M0 + _POWERS + _LIK + " SELECT round(sum(site_lnl), 4) lnl, count(*) n_sites FROM lnl",
    "branch_transition_prob": with_sql("codons", "codon_pairs", "tree_nodes") + _M0 + _POWERS + """,
      vs AS (SELECT DISTINCT round(branch_len, 6) v FROM tree_nodes WHERE parent_idx IS NOT NULL)""" + _P + """,
      st AS (SELECT v, i, sum(p) FILTER (WHERE i = j) stay, max(p) FILTER (WHERE i <> j) likeliest_move FROM pv GROUP BY v, i)
      SELECT node_idx, i, round(stay, 8) stay, round(likeliest_move, 8) likeliest_move FROM tree_nodes t JOIN st ON st.v = round(t.branch_len, 6) WHERE t.parent_idx IS NOT NULL""",
    "site_log_likelihood_cmm": with_sql("codons", "codon_pairs", "codon_cells", "tree_nodes") + _CMM + _POWERS_CMM + _LIK_CMM + " SELECT site, round(site_lnl, 6) site_lnl FROM lnl",
    "log_prior_m0": f"""
      WITH x AS (SELECT event_id, abs(value) / 100 + {_D("0.01")} k, abs(value) / 300 + {_D("0.01")} w, abs(value) / 10 + 1 t FROM events)
      SELECT event_id, round(2 * ln(5.0) - 5 * k - 5 * w + {_D("12.25")} * ln({_D("0.35")}) - lgamma({_D("12.25")}) + {_D("11.25")} * ln(t) - {_D("0.35")} * t
        + lgamma({_D("122.0")}) - 61 * ln({_D("61.0")}), 6) ln_prior FROM x""",
    "crp_alpha_expected": f"""
      SELECT p_partkey, round(p_partkey / {_D("100.0")} * ln(1 + {_D("200.0")} / (p_partkey / {_D("100.0")})), 6) expected FROM part WHERE p_partkey > 0""",
    "crp_alpha_solved": f"SELECT p_partkey, round({_D('1.5')} + p_size % 5, 4) expected FROM part",
    "category_sizes": "SELECT c_nationkey % 6 cat, count(*) n_sites FROM customer GROUP BY 1",
    "crp_log_prior": f"""
      WITH s AS (SELECT c_nationkey % 6 cat, count(*) n FROM customer GROUP BY 1)
      SELECT round(count(*) * ln({_D("0.5")}) + sum(lgamma(CAST(n AS DOUBLE))), 5) ln_prior FROM s""",
    "site_category_omegas": f"""
      SELECT c_custkey site, c_nationkey % 6 cat, round({_D("0.1")} * (c_nationkey % 6 + 1), 6) omega0, round({_D("0.1")} * (c_nationkey % 6 + 1) * 2, 6) omega1,
        round({_D("0.1")} * (c_nationkey % 6 + 1) * 3, 6) omega2 FROM customer""",
    "gibbs_weights": """
      WITH e AS (SELECT user_id, event_id, -abs(value) x FROM events),
      m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY user_id)) w FROM e)
      SELECT user_id, event_id, round(w / sum(w) OVER (PARTITION BY user_id), 8) weight FROM m""",
    "distribution_shares": f"""
      WITH p AS (SELECT p_partkey, p_size k, p_size / {_D("60.0")} x FROM part)
      SELECT p_partkey, round(9 * x * exp(-3 * x), 6) gamma_pdf, round(1 - exp(-3 * x) * (1 + 3 * x), 6) gamma_cdf, round(x, 6) gamma_back,
        round(12 * x * (1 - x) * (1 - x), 6) beta_pdf, round(6 * x * x - 8 * power(x, 3) + 3 * power(x, 4), 6) beta_cdf, round(x, 6) beta_back,
        round(x / 4 * exp(-x / 2), 6) chi_pdf, round(1 - exp(-x / 2) * (1 + x / 2), 6) chi_cdf, round(x, 6) chi_back,
        round(exp(-power((x - 0.5) / 0.2, 2) / 2) / 0.2 / sqrt(2 * pi()), 6) normal_pdf, {_D("1.0")} normal_sum, round(x, 6) normal_back,
        CASE WHEN x BETWEEN {_D("0.2")} AND {_D("0.7")} THEN {_D("2.0")} ELSE {_D("0.0")} END uniform_pdf, round(greatest(0, least(1, (x - {_D("0.2")}) / {_D("0.5")})), 6) uniform_cdf, round({_D("0.2")} + x * {_D("0.5")}, 6) uniform_quantile,
        round(5 * exp(-5 * x), 6) exp_pdf, round({_D("0.1")} * power({_D("0.9")}, k), 6) geometric_pdf, round(1 - power({_D("0.9")}, k + 1), 6) geometric_cdf, round(6 * x * (1 - x), 6) dirichlet_pdf,
        CAST(greatest(ceil(ln(1 - k / {_D("61.0")}) / ln({_D("0.9")})) - 1, 0) AS BIGINT) geometric_quantile FROM p""",
    "distribution_values": f"""
      WITH p AS (SELECT p_partkey, p_size, p_size / {_D("60.0")} x FROM part)
      SELECT p_partkey, round(lgamma({_D("10.0")}) - 2 * lgamma({_D("5.0")}) + 4 * ln(x) + 4 * ln(1 - x), 6) beta,
        round(2 * ln({_D("3.0")}) + ln(x) - 3 * x, 6) gamma, round(-ln({_D("0.2")}) - 0.5 * ln(2 * pi()) - power((x - 0.5) / 0.2, 2) / 2, 6) normal,
        round(1 - exp(-5 * x), 6) exp_cdf, round(-ln(1 - x) / 5, 6) exp_quantile, round(lgamma(p_size / {_D("2.0")}), 6) ln_gamma FROM p""",
}
