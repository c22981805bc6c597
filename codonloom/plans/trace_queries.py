"""Queries on traces, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.operators import traces as tr
from codonloom.sources.adapters import read, trace, with_sql


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def trace_rows(spark, d):
    return trace(spark, d)


def trace_burnin_summary(spark, d):
    return rounded(tr.summary(tr.after_burn_in(trace(spark, d), 0.1), "chain", "param"), "mean", "variance", "least", "most")


def trace_thin(spark, d):
    return tr.thin(trace(spark, d), 10)


def trace_density(spark, d):
    """200 bins from the least value to beyond the largest."""
    t = trace(spark, d)
    low, high = t.agg(F.floor(F.min("value")).cast("double"), F.floor(F.max("value") + 1).cast("double")).first()
    return rounded(tr.density(t, 200, low, high, "param"), "density")


def trace_wide(spark, d):
    params = ["click", "error", "login", "purchase", "view"]
    known = trace(spark, d).withColumn("param", F.element_at(F.array(*[F.lit(p) for p in params]), (F.length("param") % 5 + 1).cast("int")))
    return tr.wide(known, params)


def acceptance_rate(spark, d):
    p = read(spark, d, "events").select("event_type", (F.col("value") > 50).alias("accepted"))
    return rounded(tr.acceptance_rates(p, "event_type"), "rate")


def trace_autocorrelation(spark, d):
    return rounded(tr.autocorrelation(trace(spark, d)), "score").select("chain", "pos", "score")


def smooth_autocorrelation(spark, d):
    t = trace(spark, d)
    rows = t.groupBy("chain", "param").agg(F.count(F.lit(1)).alias("n")).groupBy("chain").agg(F.min("n").alias("n"))
    return tr.smooth_autocorrelation(tr.autocorrelation(t), rows).withColumn("smooth", F.round("smooth", 4))


def categorical_draw(spark, d):
    w = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("weight"))
    return tr.draw(w, F.lit(0.37), "l_orderkey")


def best_samples(spark, d):
    return tr.best(trace(spark, d), 25)


def chain_union(spark, d):
    """The samples of two chains as one, with where they came from."""
    t = trace(spark, d)
    return t.filter("chain = 0").withColumn("run", F.lit("a")).unionByName(t.filter("chain = 3").withColumn("run", F.lit("b"))).groupBy("run", "param").agg(F.count(F.lit(1)).alias("n"))


def node_means(spark, d):
    """Posterior means of sites left-joined to the nodes they belong to."""
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("node_idx"), F.col("n_name").alias("name"))
    means = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node_idx")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return nodes.join(means, "node_idx", "left")


def regime_of_state(spark, d):
    """dN/dS of sampled states by way of their regime."""
    dnds = F.array(*[F.lit(x) for x in (0.1, 0.5, 1.5)])
    s = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 183).cast("int").alias("state"))
    return s.select("o_orderkey", "state", F.element_at(dnds, F.floor(F.col("state") / 61).cast("int") + 1).alias("dnds"))


def running_best(spark, d):
    return tr.running_best(trace(spark, d))


def site_params(spark, d):
    """Balances of customers as parameters ``segment[customer]``."""
    rows = read(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("iteration"), F.lit(0).alias("chain"), F.concat("c_mktsegment", F.lit("["), F.col("c_custkey").cast("string"), F.lit("]")).alias("param"), F.round("c_acctbal", 2).alias("value"))
    return rows


def trace_projection(spark, d):
    return tr.projected(site_params(spark, d), r"^([A-M]\w*)\[(\d+)\]$").select("iteration", "name", "site", "value")


def random_series(spark, d):
    return tr.some_params(site_params(spark, d), 15, 7)


QUERIES = {
    f.__name__: f
    for f in (
        trace_rows, trace_burnin_summary, trace_thin, trace_density, trace_wide, acceptance_rate, trace_autocorrelation, smooth_autocorrelation,
        categorical_draw, best_samples, chain_union, node_means, regime_of_state, running_best, trace_projection, random_series,
    )
}

_T = with_sql("trace")
_AUTO = """,
rk AS (SELECT chain, param, value, row_number() OVER (PARTITION BY chain, param ORDER BY iteration) pos FROM trace),
win AS (SELECT a.chain, a.param, a.pos, b.pos - a.pos + 25 k, b.value x FROM rk a JOIN rk b ON a.chain = b.chain AND a.param = b.param AND b.pos BETWEEN a.pos - 24 AND a.pos WHERE a.pos >= 25),
mom AS (SELECT chain, param, pos, avg(x) m, var_pop(x) v FROM win GROUP BY chain, param, pos),
prod AS (SELECT w.chain, w.pos, z.k - w.k lag, sum((w.x - mom.m) * (z.x - mom.m)) p
  FROM win w JOIN win z ON w.chain = z.chain AND w.param = z.param AND w.pos = z.pos AND z.k > w.k
  JOIN mom ON mom.chain = w.chain AND mom.param = w.param AND mom.pos = w.pos GROUP BY w.chain, w.pos, z.k - w.k),
var_ AS (SELECT chain, pos, sum(v) v FROM mom GROUP BY chain, pos),
score AS (SELECT p.chain, p.pos, 2 - sum(abs(CASE WHEN var_.v > 0 THEN p.p / ((25 - p.lag) * var_.v) ELSE 0 END)) / 25 score
  FROM prod p JOIN var_ ON var_.chain = p.chain AND var_.pos = p.pos GROUP BY p.chain, p.pos)"""

SQL = {
    "trace_rows": _T + " SELECT iteration, chain, param, value FROM trace",
    "trace_burnin_summary": _T + """,
      r AS (SELECT *, row_number() OVER (PARTITION BY chain, param ORDER BY iteration) rn, count(*) OVER (PARTITION BY chain, param) c FROM trace)
      SELECT chain, param, count(value) n, round(avg(value), 6) mean, round(var_pop(value), 6) variance, round(min(value), 6) least, round(max(value), 6) most
      FROM r WHERE rn > floor(c * CAST(0.1 AS DOUBLE)) GROUP BY chain, param""",
    "trace_thin": _T + " SELECT iteration, chain, param, value FROM trace WHERE iteration % 10 = 0",
    "trace_density": _T + """,
      lim AS (SELECT CAST(floor(min(value)) AS DOUBLE) lo, (CAST(floor(max(value) + 1) AS DOUBLE) - CAST(floor(min(value)) AS DOUBLE)) / 200 w FROM trace),
      b AS (SELECT param, CAST(floor((value - lo) / w) AS INT) bin, count(*) n FROM trace, lim GROUP BY 1, 2)
      SELECT param, bin, n, round(n / (sum(n) OVER (PARTITION BY param) * w), 6) density FROM b, lim""",
    "trace_wide": _T + """,
      k AS (SELECT iteration, chain, value, length(param) % 5 p FROM trace)
      SELECT iteration, chain, max(CASE WHEN p = 0 THEN value END) click, max(CASE WHEN p = 1 THEN value END) error, max(CASE WHEN p = 2 THEN value END) login,
        max(CASE WHEN p = 3 THEN value END) purchase, max(CASE WHEN p = 4 THEN value END) AS view FROM k GROUP BY iteration, chain""",
    "acceptance_rate": """
      SELECT event_type, count(*) FILTER (WHERE value > 50) n_accepted, count(*) n_proposed, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) rate
      FROM events GROUP BY event_type""",
    "trace_autocorrelation": _T + _AUTO + " SELECT chain, CAST(pos AS INT) pos, round(score, 6) score FROM score",
    "smooth_autocorrelation": _T + _AUTO + """,
      cnt AS (SELECT chain, min(n) n FROM (SELECT chain, param, count(*) n FROM trace GROUP BY chain, param) c GROUP BY chain)
      SELECT s.chain, round(sum(s.score) / (max(cnt.n) - 24), 4) smooth FROM score s JOIN cnt ON cnt.chain = s.chain WHERE s.pos < cnt.n AND cnt.n >= 25 GROUP BY s.chain""",
    "categorical_draw": """
      WITH c AS (SELECT l_orderkey, l_linenumber idx, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / sum(l_quantity) OVER (PARTITION BY l_orderkey) c FROM lineitem)
      SELECT l_orderkey, min(idx) drawn FROM c WHERE c > CAST(0.37 AS DOUBLE) GROUP BY l_orderkey""",
    "best_samples": _T + " SELECT iteration, chain, param, value FROM trace ORDER BY value DESC, iteration LIMIT 25",
    "chain_union": _T + " SELECT CASE WHEN chain = 0 THEN 'a' ELSE 'b' END run, param, count(*) n FROM trace WHERE chain IN (0, 3) GROUP BY 1, 2",
    "node_means": """
      SELECT n_nationkey node_idx, n_name AS name, m.mean FROM nation LEFT JOIN
        (SELECT c_nationkey, round(avg(c_acctbal), 4) mean FROM customer GROUP BY c_nationkey) m ON m.c_nationkey = n_nationkey""",
    "regime_of_state": """
      SELECT o_orderkey, CAST(o_custkey % 183 AS INT) state, CASE WHEN o_custkey % 183 < 61 THEN CAST(0.1 AS DOUBLE) WHEN o_custkey % 183 < 122 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END dnds FROM orders""",
    "trace_projection": "SELECT c_custkey % 1000 iteration, c_mktsegment AS name, CAST(c_custkey AS INT) site, round(c_acctbal, 2) AS value FROM customer WHERE regexp_matches(c_mktsegment, '^[A-M]')",
    "running_best": _T + " SELECT chain, iteration, max(value) OVER (PARTITION BY chain ORDER BY iteration ROWS UNBOUNDED PRECEDING) best FROM trace",
}
