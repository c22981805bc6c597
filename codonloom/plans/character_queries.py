"""Queries on codons and characters, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.functions import genetic
from codonloom.operators import characters as ch
from codonloom.operators import index_sets
from codonloom.sources.adapters import ambiguous_cells, codon_cells, sequences, with_sql


def codon_table(spark, d):
    return genetic.codons(spark)


def codon_pair_counts(spark, d):
    return genetic.codon_pairs(genetic.codons(spark)).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_transition").alias("n_transitions"), F.count_if("is_synonymous").alias("n_synonymous"),
        F.count_if(~F.col("is_synonymous")).alias("n_nonsynonymous"),
    )


def genetic_code_sizes(spark, d):
    return genetic.genetic_codes(spark).filter("code = 'standard'").groupBy("aa").agg(F.count(F.lit(1)).alias("n_codons"))


def codon_masks(spark, d):
    return codon_cells(spark, d)


def codon_recoding(spark, d):
    return ch.codon_masks(ch.recode(sequences(spark, d))).select("taxon_idx", "site", "codon", "mask")


def translated_codons(spark, d):
    return ch.translate_codons(ch.recode(sequences(spark, d)), genetic.genetic_codes(spark).filter("code = 'standard'")).select("taxon_idx", "site", "codon", "aa")


def proteins(spark, d):
    return ch.protein(sequences(spark, d), genetic.genetic_codes(spark).filter("code = 'standard'"))


def ambiguity_per_taxon(spark, d):
    return ch.ambiguity(ambiguous_cells(spark, d))


def column_summary(spark, d):
    return ch.column_summary(ambiguous_cells(spark, d)).select("site", "is_constant", "is_gapped", "n_states", "n_missing")


def constant_columns(spark, d):
    return ch.column_summary(codon_cells(spark, d)).filter("is_constant").select("site")


def site_patterns(spark, d):
    return ch.site_patterns(codon_cells(spark, d)).select("pattern", "n_sites", "first_site")


def pattern_of_site(spark, d):
    return ch.pattern_of_site(codon_cells(spark, d))


def complete_patterns(spark, d):
    return ch.drop_missing_patterns(codon_cells(spark, d)).select("pattern", "n_sites")


def pairwise_distance(spark, d):
    return ch.pair_counts(ambiguous_cells(spark, d))


def state_intersections(spark, d):
    return ch.state_intersections(ambiguous_cells(spark, d), 3, 7)


def expanded_states(spark, d):
    return ch.expand_states(ambiguous_cells(spark, d))


def gap_characters(spark, d):
    gapped = sequences(spark, d).select("taxon_idx", F.regexp_replace("seq", "^(.{30})...", "$1---").alias("_g"), "seq")
    return ch.gap_characters(gapped.select("taxon_idx", F.when(F.col("taxon_idx") % 10 == 0, F.col("_g")).otherwise(F.col("seq")).alias("seq")))


def nucleotide_composition(spark, d):
    return ch.nucleotide_masks(sequences(spark, d)).groupBy("pos", "mask").agg(F.count(F.lit(1)).alias("n"))


def step_matrices(spark, d):
    return ch.step_matrix(5, True, spark).join(ch.step_matrix(5, False, spark).withColumnRenamed("steps", "unordered"), ["i", "j"]).withColumnRenamed("steps", "ordered")


def codon_positions(spark, d):
    """Three position sets of one size, joined to codons by rank."""
    idx = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("idx")).filter("idx > 0")
    return ch.positions_in_codon(idx.select("idx", (F.pmod(F.col("idx") - 1, F.lit(3)) + 1).alias("position")))


SETS = [("early", "1-40"), ("third", "3-.\\3"), ("some", "5 7 9-12"), ("every", "ALL")]


def sets_table(spark):
    return spark.createDataFrame(SETS, "name string, definition string")


def set_expansion(spark, d):
    return index_sets.expand(sets_table(spark), 200)


def set_references(spark, d):
    """Customers as labels, the set of each nation by label, of each region by its nations'
    sets, and the world by regions: sets in sets, three deep."""
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    last = c.agg(F.max("c_custkey")).first()[0] + 1
    labels = c.select(F.col("c_name").alias("label"), (F.col("c_custkey") + 1).cast("int").alias("idx"))
    nations = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.concat(F.lit("nation "), "n_name").alias("name")).agg(F.array_join(F.collect_list(quoted(F.col("c_name"))), " ").alias("definition"))
    used = c.select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    regions = n.join(used, "n_nationkey").join(r, n.n_regionkey == r.r_regionkey).groupBy(F.concat(F.lit("region "), "r_name").alias("name")).agg(F.array_join(F.collect_list(quoted(F.concat(F.lit("NATION "), "n_name"))), " ").alias("definition"))
    world = regions.groupBy(F.lit("world").alias("name")).agg(F.array_join(F.collect_list(quoted(F.col("name"))), " ").alias("definition"))
    return index_sets.expand(nations.union(regions).union(world), last, labels)


def vector_partition(spark, d):
    """Parts by brand and by size, as vectors of as many words as there are parts."""
    p = spark.read.parquet(f"{d}/part.parquet")
    words = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.col(c).cast("string").alias("w")))), lambda x: F.concat(F.lit("'"), x["w"], F.lit("'"))), " ")
    rows = p.groupBy(F.lit("brand").alias("name")).agg(words("p_brand").alias("definition")).union(p.groupBy(F.lit("size").alias("name")).agg(words("p_size").alias("definition")))
    return index_sets.expand_vector(rows, p.count())


def partition_expansion(spark, d):
    """The partition of 90 sites by position in the codon, and a weight set."""
    rows = [("codon", r"pos1: 1-.\3, pos2: 2-.\3, pos3: 3-.\3"), ("weights", "2: 1-10 20, 1: 11-19 21-.")]
    return index_sets.expand_partition(spark.createDataFrame(rows, "name string, definition string"), 90)


def set_ranges(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 10).cast("string").alias("name"), (F.col("o_orderkey") % 200).cast("int").alias("idx"))
    return index_sets.ranges(keys.distinct())


def partition_overlaps(spark, d):
    parts = spark.read.parquet(f"{d}/orders.parquet").select(
        F.lit("by_customer").alias("name"), (F.col("o_custkey") % 10).cast("int").alias("subset"), (F.col("o_orderkey") % 5000).cast("int").alias("idx")
    )
    return index_sets.overlaps(parts)


def excluded_characters(spark, d):
    sets = index_sets.expand(sets_table(spark), 200).withColumn("idx", F.col("idx") - 1)
    left = ch.exclude(codon_cells(spark, d), sets, "third")
    return left.groupBy("taxon_idx").agg(F.count(F.lit(1)).alias("n_active"), F.count("state").alias("n_observed"))


def active_characters(spark, d):
    sets = index_sets.expand(sets_table(spark), 200).withColumn("idx", F.col("idx") - 1)
    return ch.active_count(codon_cells(spark, d), sets, ["third", "some"])


def subset_by_set(spark, d):
    sets = index_sets.expand(sets_table(spark), 200).select(F.lit("charset").alias("kind"), "name", (F.col("idx") - 1).alias("idx"))
    return ch.subset(codon_cells(spark, d), sets, "some").select("taxon_idx", "site", "mask")


def character_weights(spark, d):
    weights = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("site"), F.col("p_size").cast("double").alias("weight"))
    return ch.site_patterns(codon_cells(spark, d), weights).select("first_site", "n_sites", F.round("weight", 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        codon_table, codon_pair_counts, genetic_code_sizes, codon_masks, codon_recoding, translated_codons, proteins, ambiguity_per_taxon,
        column_summary, constant_columns, site_patterns, pattern_of_site, complete_patterns, pairwise_distance, state_intersections,
        expanded_states, gap_characters, nucleotide_composition, step_matrices, codon_positions, set_expansion, set_references, vector_partition, partition_expansion, set_ranges, partition_overlaps,
        excluded_characters, active_characters, subset_by_set, character_weights,
    )
}

_CUT = """,
cut AS (SELECT taxon_idx, CAST(unnest(range(length(seq) // 3)) AS INT) site, unnest(regexp_extract_all(seq, '...')) codon FROM sequences WHERE length(seq) >= 3)"""
_AA = "CASE WHEN a.aa IS NULL THEN '?' ELSE a.aa END"
_SETS = """,
sets AS (SELECT 'early' AS name, CAST(range AS INT) idx FROM range(1, 41) UNION ALL SELECT 'third', CAST(range AS INT) FROM range(3, 201, 3)
  UNION ALL SELECT 'every', CAST(range AS INT) FROM range(1, 201) UNION ALL SELECT 'some', CAST(range AS INT) FROM range(9, 13)
  UNION ALL SELECT 'some', 5 UNION ALL SELECT 'some', 7)"""
_PATTERNS = """,
cols AS (SELECT site, string_agg(CAST(mask AS VARCHAR), ',' ORDER BY taxon_idx) pattern FROM codon_cells GROUP BY site)"""
_ALL = "2305843009213693951"

SQL = {
    "set_references": """
      WITH c AS (SELECT CAST(c_custkey + 1 AS INT) idx, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT 'nation ' || n_name AS name, idx FROM c UNION ALL SELECT 'region ' || r_name, idx FROM c UNION ALL SELECT 'world', idx FROM c""",
    "vector_partition": """
      WITH p AS (SELECT *, CAST(row_number() OVER (ORDER BY p_partkey) AS INT) idx FROM part)
      SELECT 'brand' AS name, p_brand subset, idx FROM p UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), idx FROM p""",
    "codon_table": with_sql("codons") + " SELECT state, codon, aa FROM codons",
    "codon_pair_counts": with_sql("codons", "codon_pairs") + """
      SELECT count(*) n_pairs, count(*) FILTER (WHERE is_transition) n_transitions, count(*) FILTER (WHERE is_synonymous) n_synonymous,
        count(*) FILTER (WHERE NOT is_synonymous) n_nonsynonymous FROM codon_pairs""",
    "genetic_code_sizes": with_sql("codons") + " SELECT aa, count(*) n_codons FROM amino GROUP BY aa",
    "codon_masks": with_sql("codon_cells") + " SELECT taxon_idx, site, state, mask FROM codon_cells",
    "codon_recoding": with_sql("sequences", "codons") + _CUT + f"""
      SELECT taxon_idx, site, cut.codon, CASE WHEN c.state IS NULL THEN {_ALL} ELSE CAST(1 AS BIGINT) << c.state END mask
      FROM cut LEFT JOIN codons c ON c.codon = cut.codon""",
    "translated_codons": with_sql("sequences", "codons") + _CUT + f" SELECT taxon_idx, site, cut.codon, {_AA} aa FROM cut LEFT JOIN amino a ON a.codon = cut.codon",
    "proteins": with_sql("sequences", "codons") + _CUT + f"""
      SELECT taxon_idx, string_agg({_AA}, '' ORDER BY site) protein FROM cut LEFT JOIN amino a ON a.codon = cut.codon GROUP BY taxon_idx""",
    "ambiguity_per_taxon": with_sql("ambiguous_cells") + f"""
      SELECT taxon_idx, count(*) FILTER (WHERE bit_count(mask) > 1 AND mask <> {_ALL}) n_ambiguous,
        count(*) FILTER (WHERE mask = {_ALL}) n_missing, count(*) n_cells FROM ambiguous_cells GROUP BY taxon_idx""",
    "column_summary": with_sql("ambiguous_cells") + f"""
      SELECT site, bit_and(mask) <> 0 is_constant, count(*) FILTER (WHERE mask = {_ALL}) > 0 is_gapped,
        CAST(coalesce(bit_count(bit_or(CASE WHEN mask <> {_ALL} THEN mask END)), 0) AS INT) n_states,
        count(*) FILTER (WHERE mask = {_ALL}) n_missing FROM ambiguous_cells GROUP BY site""",
    "constant_columns": with_sql("codon_cells") + " SELECT site FROM codon_cells GROUP BY site HAVING bit_and(mask) <> 0",
    "site_patterns": with_sql("codon_cells") + _PATTERNS + """
      SELECT pattern, count(*) n_sites, min(site) first_site FROM cols GROUP BY pattern""",
    "pattern_of_site": with_sql("codon_cells") + _PATTERNS + " SELECT site, min(site) OVER (PARTITION BY pattern) first_site FROM cols",
    "complete_patterns": with_sql("codon_cells") + _PATTERNS + f" SELECT pattern, count(*) n_sites FROM cols WHERE pattern NOT LIKE '%{_ALL}%' GROUP BY pattern",
    "pairwise_distance": with_sql("ambiguous_cells") + f"""
      SELECT a.taxon_idx taxon_a, b.taxon_idx taxon_b, count(*) n_sites, count(*) FILTER (WHERE a.mask & b.mask <> 0) n_compatible,
        count(*) FILTER (WHERE a.mask & b.mask = 0) n_diff, bool_and(a.mask & b.mask = a.mask) a_within_b
      FROM ambiguous_cells a JOIN ambiguous_cells b ON a.site = b.site AND a.taxon_idx < b.taxon_idx
      WHERE a.mask <> {_ALL} AND b.mask <> {_ALL} GROUP BY a.taxon_idx, b.taxon_idx""",
    "state_intersections": with_sql("ambiguous_cells") + """
      SELECT a.site, a.mask & b.mask shared_mask, CAST(bit_count(a.mask & b.mask) AS INT) n_shared
      FROM ambiguous_cells a JOIN ambiguous_cells b ON a.site = b.site WHERE a.taxon_idx = 3 AND b.taxon_idx = 7""",
    "expanded_states": with_sql("ambiguous_cells") + """
      SELECT taxon_idx, site, CAST(r.range AS INT) state FROM ambiguous_cells CROSS JOIN range(61) r
      WHERE (mask >> CAST(r.range AS INT)) & 1 = 1""",
    "gap_characters": with_sql("sequences") + """,
      gapped AS (SELECT taxon_idx, CASE WHEN taxon_idx % 10 = 0 AND length(seq) >= 33 THEN substr(seq, 1, 30) || '---' || substr(seq, 34) ELSE seq END seq FROM sequences)
      SELECT taxon_idx, CAST(r.range AS INT) pos, CAST(substr(seq, CAST(r.range AS INT), 1) = '-' AS INT) gap FROM gapped CROSS JOIN range(31, 34) r WHERE r.range <= length(seq)""",
    "nucleotide_composition": with_sql("sequences") + """,
      ch AS (SELECT unnest(string_split(seq, '')) c, unnest(range(1, length(seq) + 1)) pos FROM sequences WHERE length(seq) > 0)
      SELECT CAST(pos AS INT) pos, CASE c WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END mask, count(*) n FROM ch GROUP BY 1, 2""",
    "step_matrices": """SELECT CAST(a.range AS INT) i, CAST(b.range AS INT) j, CAST(abs(a.range - b.range) AS INT) ordered,
      CAST(a.range <> b.range AS INT) unordered FROM range(5) a CROSS JOIN range(5) b""",
    "codon_positions": """
      WITH p AS (SELECT CAST(p_partkey AS INT) idx, (p_partkey - 1) % 3 + 1 pos FROM part WHERE p_partkey > 0),
      r AS (SELECT idx, pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY idx) - 1 AS INT) site FROM p)
      SELECT site, max(CASE WHEN pos = 1 THEN idx END) pos1, max(CASE WHEN pos = 2 THEN idx END) pos2, max(CASE WHEN pos = 3 THEN idx END) pos3 FROM r GROUP BY site""",
    "set_expansion": "WITH x AS (SELECT 1)" + _SETS + " SELECT name, idx FROM sets",
    "partition_expansion": """
      SELECT 'codon' AS name, 'pos' || CAST((range - 1) % 3 + 1 AS VARCHAR) subset, CAST(range AS INT) idx FROM range(1, 91)
      UNION ALL SELECT 'weights', CASE WHEN range <= 10 OR range = 20 THEN '2' ELSE '1' END, CAST(range AS INT) FROM range(1, 91)""",
    "set_ranges": """
      WITH k AS (SELECT DISTINCT CAST(o_custkey % 10 AS VARCHAR) AS name, CAST(o_orderkey % 200 AS INT) idx FROM orders),
      i AS (SELECT name, idx, idx - row_number() OVER (PARTITION BY name ORDER BY idx) grp FROM k),
      r AS (SELECT name, min(idx) a, max(idx) b FROM i GROUP BY name, grp)
      SELECT name, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ' ' ORDER BY a) definition FROM r GROUP BY name""",
    "partition_overlaps": """
      SELECT 'by_customer' AS name, CAST(o_orderkey % 5000 AS INT) idx, count(DISTINCT o_custkey % 10) n_subsets FROM orders
      GROUP BY 2 HAVING count(DISTINCT o_custkey % 10) > 1""",
    "excluded_characters": with_sql("codon_cells") + """
      SELECT taxon_idx, count(*) n_active, count(state) n_observed FROM codon_cells WHERE (site + 1) % 3 <> 0 GROUP BY taxon_idx""",
    "active_characters": with_sql("codon_cells") + _SETS + " SELECT count(*) FILTER (WHERE site NOT IN (SELECT idx - 1 FROM sets WHERE name IN ('third', 'some'))) n_active, count(*) n_sites FROM (SELECT DISTINCT site FROM codon_cells)",
    "subset_by_set": with_sql("codon_cells") + " SELECT taxon_idx, site, mask FROM codon_cells WHERE site + 1 IN (5, 7, 9, 10, 11, 12)",
    "character_weights": with_sql("codon_cells") + _PATTERNS + """,
      w AS (SELECT CAST(p_partkey AS INT) site, CAST(p_size AS DOUBLE) weight FROM part)
      SELECT min(cols.site) first_site, count(*) n_sites, round(sum(coalesce(w.weight, 1.0)), 6) weight
      FROM cols LEFT JOIN w ON w.site = cols.site GROUP BY pattern""",
}
