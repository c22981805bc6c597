"""Inputs of the engine laid out from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.functions.genetic import ALL, state_mask

TAXA, SITES = 25, 200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, taxa: int = TAXA, sites: int = SITES) -> DataFrame:
    """Every (taxon_idx, site) cell."""
    return spark.range(taxa * sites).select((F.col("id") % taxa).cast("int").alias("taxon_idx"), F.floor(F.col("id") / taxa).cast("int").alias("site"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = read(spark, sf_dir, "orders").select((F.col("o_custkey") % TAXA).cast("int").alias("taxon_idx"), (k % SITES).cast("int").alias("site"), k.alias("k"))
    return g.withColumn("state", ((F.col("site") * 17 + F.when(F.col("k") % 5 == 0, F.col("k") % 61).otherwise(0)) % 61).cast("int"))


def codon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon_idx, site, state (null if unobserved), mask: one codon a cell."""
    seen = observations(spark, sf_dir).groupBy("taxon_idx", "site").agg(F.min_by("state", "k").alias("state"))
    return grid(spark).join(seen, ["taxon_idx", "site"], "left").withColumn("mask", state_mask(F.col("state")))


def ambiguous_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon_idx, site, mask: every codon that was observed in a cell."""
    seen = observations(spark, sf_dir).groupBy("taxon_idx", "site").agg(F.bit_or(state_mask(F.col("state"))).alias("mask"))
    return grid(spark).join(seen, ["taxon_idx", "site"], "left").withColumn("mask", F.coalesce("mask", F.lit(ALL)))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_idx, parent_idx, name, is_tip, branch_len: nations under regions under a root."""
    tips = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("node_idx"), (F.col("n_regionkey") + 25).cast("int").alias("parent_idx"),
        F.col("n_name").alias("name"), F.lit(True).alias("is_tip"), (F.lit(0.02) * (1 + F.col("n_nationkey") % 5)).alias("branch_len"),
    )
    inner = read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 25).cast("int"), F.lit(30), F.col("r_name"), F.lit(False), F.lit(0.05) * (1 + F.col("r_regionkey")),
    )
    root = spark.createDataFrame([(30, None, "Root", False, 0.0)], "node_idx int, parent_idx int, name string, is_tip boolean, branch_len double")
    return tips.union(inner).union(root)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iteration, chain, param, value: the events as a long trace."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("iteration"), (F.col("user_id") % 4).cast("int").alias("chain"), F.col("event_type").alias("param"), "value",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon_idx, seq: nucleotides from all letters of each document."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("taxon_idx"), letters.alias("_l"))
    seq = F.translate(F.upper("_l"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return d.select("taxon_idx", F.coalesce(seq, F.lit("")).alias("seq"))


#: The same adapters as DuckDB common table expressions, for the oracles.
SQL = {
    "codon_cells": """
g AS (SELECT CAST(o_custkey % 25 AS INT) taxon_idx, CAST(o_orderkey % 200 AS INT) site, o_orderkey k FROM orders),
st AS (SELECT taxon_idx, site, min_by(CAST((site*17 + CASE WHEN k % 5 = 0 THEN k % 61 ELSE 0 END) % 61 AS INT), k) state FROM g GROUP BY taxon_idx, site),
grid AS (SELECT CAST(t.range AS INT) taxon_idx, CAST(s.range AS INT) site FROM range(25) t CROSS JOIN range(200) s),
codon_cells AS (SELECT grid.taxon_idx, grid.site, st.state,
  CASE WHEN st.state IS NULL THEN 2305843009213693951 ELSE CAST(1 AS BIGINT) << st.state END mask
  FROM grid LEFT JOIN st ON st.taxon_idx = grid.taxon_idx AND st.site = grid.site)""",
    "ambiguous_cells": """
ga AS (SELECT CAST(o_custkey % 25 AS INT) taxon_idx, CAST(o_orderkey % 200 AS INT) site,
  CAST((o_orderkey % 200 * 17 + CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 61 ELSE 0 END) % 61 AS INT) state FROM orders),
sa AS (SELECT taxon_idx, site, bit_or(CAST(1 AS BIGINT) << state) mask FROM ga GROUP BY taxon_idx, site),
grida AS (SELECT CAST(t.range AS INT) taxon_idx, CAST(s.range AS INT) site FROM range(25) t CROSS JOIN range(200) s),
ambiguous_cells AS (SELECT grida.taxon_idx, grida.site, coalesce(sa.mask, 2305843009213693951) mask
  FROM grida LEFT JOIN sa ON sa.taxon_idx = grida.taxon_idx AND sa.site = grida.site)""",
    "tree_nodes": """
tree_nodes AS (
  SELECT CAST(n_nationkey AS INT) node_idx, CAST(25 + n_regionkey AS INT) parent_idx, n_name AS name, true is_tip,
    CAST(0.02 AS DOUBLE)*(1 + n_nationkey % 5) branch_len FROM nation
  UNION ALL SELECT CAST(25 + r_regionkey AS INT), 30, r_name, false, CAST(0.05 AS DOUBLE)*(1 + r_regionkey) FROM region
  UNION ALL SELECT 30, CAST(NULL AS INT), 'Root', false, CAST(0.0 AS DOUBLE))""",
    "trace": """
trace AS (SELECT event_id iteration, CAST(user_id % 4 AS INT) chain, event_type param, value FROM events)""",
    "sequences": """
letters AS (SELECT doc_id taxon_idx, coalesce(regexp_replace(text, '[^A-Za-z]', '', 'g'), '') l FROM documents),
sequences AS (SELECT taxon_idx, translate(upper(l), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') seq FROM letters)""",
    "codons": """
bases(b, i) AS (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)),
all64 AS (SELECT x.b || y.b || z.b codon, 16*x.i + 4*y.i + z.i pos FROM bases x CROSS JOIN bases y CROSS JOIN bases z),
amino AS (SELECT codon, pos, substr('KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF', pos + 1, 1) aa FROM all64),
codons AS (SELECT CAST(row_number() OVER (ORDER BY codon) - 1 AS INT) state, codon, aa FROM amino WHERE aa <> '*')""",
    "codon_pairs": """
codon_pairs AS (SELECT a.state i, b.state j, a.codon codon_i, b.codon codon_j, a.aa = b.aa is_synonymous,
    (CASE WHEN substr(a.codon,1,1) <> substr(b.codon,1,1) THEN substr(a.codon,1,1) || substr(b.codon,1,1)
          WHEN substr(a.codon,2,1) <> substr(b.codon,2,1) THEN substr(a.codon,2,1) || substr(b.codon,2,1)
          ELSE substr(a.codon,3,1) || substr(b.codon,3,1) END) IN ('AG','GA','CT','TC') is_transition
  FROM codons a JOIN codons b ON a.state < b.state AND
    CAST(substr(a.codon,1,1) <> substr(b.codon,1,1) AS INT) + CAST(substr(a.codon,2,1) <> substr(b.codon,2,1) AS INT)
    + CAST(substr(a.codon,3,1) <> substr(b.codon,3,1) AS INT) = 1)""",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ",".join(SQL[n] for n in names)
