"""Operators on character matrices: long tables (taxon, site, mask) of state sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.functions.genetic import ALL, SENSE, codons, iupac_mask
from codonloom.operators.lineage import cut, small
from codonloom.operators.ordered import running, split_join

#: What no sequence holds.
MARK = "\x01"


def recode(sequences: DataFrame, width: int = 3) -> DataFrame:
    """taxon_idx, site, codon: each sequence cut into codons, the frame from its start."""
    return sequences.select("taxon_idx", F.posexplode(pieces(F.col("seq"), width)).alias("site", "codon"))


def pieces(seq: Column, width: int = 1) -> Column:
    """A sequence cut into strings of ``width``, in one pass; an incomplete last one is left out."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{{width}}})"), 1)


def codon_masks(cells: DataFrame) -> DataFrame:
    """Codons as states and masks; gaps, partial ambiguity and stops are missing data."""
    table = codons(cells.sparkSession).select("codon", "state")
    joined = cells.join(F.broadcast(table), "codon", "left")
    mask = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("state")), F.lit(ALL))
    return joined.select("taxon_idx", "site", "codon", "state", mask.alias("mask"))


def translate_codons(cells: DataFrame, code: DataFrame) -> DataFrame:
    """Codons to amino acids under a genetic code; what isn't a codon of it is ``?``."""
    return cells.join(F.broadcast(code.select("codon", "aa")), "codon", "left").withColumn("aa", F.coalesce("aa", F.lit("?")))


def protein(sequences: DataFrame, code: DataFrame) -> DataFrame:
    """taxon_idx, protein: the amino acids of each sequence in order of site, inside the
    row. Codons are set apart by a mark, and each of the code's (at most 64, a fixed
    table) is replaced with its mark in the whole text, so no expression runs a codon."""
    text = F.concat(F.array_join(pieces(F.col("seq"), 3), MARK), F.lit(MARK))
    for r in code.select("codon", "aa").collect():
        text = F.replace(text, F.lit(r["codon"] + MARK), F.lit(r["aa"]))
    left = F.regexp_replace(text, f"(?s).{{3}}{MARK}", "?")
    return sequences.filter(F.length("seq") >= 3).select("taxon_idx", left.alias("protein"))


def ambiguity(cells: DataFrame) -> DataFrame:
    """Per taxon: cells with several states, and cells with all (missing)."""
    missing = F.col("mask") == ALL
    return cells.groupBy("taxon_idx").agg(
        F.count_if((F.bit_count("mask") > 1) & ~missing).alias("n_ambiguous"), F.count_if(missing).alias("n_missing"), F.count(F.lit(1)).alias("n_cells")
    )


def column_summary(cells: DataFrame) -> DataFrame:
    """Per site: the states common to all taxa, those seen in any, and whether one is missing.

    Missing cells don't narrow the common states nor widen the seen ones.
    """
    seen = F.when(F.col("mask") != ALL, F.col("mask"))
    out = cells.groupBy("site").agg(
        F.bit_and("mask").alias("common_mask"), F.coalesce(F.bit_or(seen), F.lit(0).cast("long")).alias("seen_mask"),
        F.count_if(F.col("mask") == ALL).alias("n_missing"),
    )
    return out.withColumns({
        "is_constant": F.col("common_mask") != 0, "is_gapped": F.col("n_missing") > 0,
        "n_states": F.bit_count("seen_mask").cast("int"),
    })


def folded_columns(cells: DataFrame) -> DataFrame:
    """site, pattern: each column's masks in order of taxon, as text (one row a site)."""
    fold = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon_idx", "mask"))), lambda x: x["mask"].cast("string")), ",")
    return cells.groupBy("site").agg(fold.alias("pattern"))


def site_patterns(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Equal columns as one: pattern, n_sites, weight, first_site.

    Sums and the first site only: a pattern that a third of all columns have is one
    partial row a task. Which sites have it, pattern_of_site tells, a row a site.
    """
    columns = folded_columns(cells)
    columns = columns.join(weights, "site", "left") if weights is not None else columns.withColumn("weight", F.lit(1.0))
    return columns.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.min("site").alias("first_site"),
    )


def pattern_of_site(cells: DataFrame) -> DataFrame:
    """site, first_site: the site that stands for each site's pattern."""
    columns = folded_columns(cells)
    first = columns.groupBy("pattern").agg(F.min("site").alias("first_site"))
    return split_join(columns, first, ["pattern"]).select("site", "first_site")  # a pattern may be that of most columns


def drop_missing_patterns(cells: DataFrame) -> DataFrame:
    """The patterns without any missing cell."""
    return site_patterns(cells).filter(~F.array_contains(F.split("pattern", ","), str(ALL)))


def pair_counts(cells: DataFrame, key: Column | None = None) -> DataFrame:
    """For each two taxa: sites where both are known, compatible and different.

    Pairs come from an equi-join on the site, so each task holds sites, not taxa;
    partial sums leave it.
    """
    a = cells.filter(F.col("mask") != ALL).select("site", F.col("taxon_idx").alias("taxon_a"), F.col("mask").alias("_a"))
    b = a.select("site", F.col("taxon_a").alias("taxon_b"), F.col("_a").alias("_b"))
    both = F.col("_a").bitwiseAND(F.col("_b"))
    return a.join(b, "site").filter(F.col("taxon_a") < F.col("taxon_b")).groupBy("taxon_a", "taxon_b").agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_if(both != 0).alias("n_compatible"), F.count_if(both == 0).alias("n_diff"),
        F.every(both == F.col("_a")).alias("a_within_b"),
    )


def state_intersections(cells: DataFrame, taxon_a: int, taxon_b: int) -> DataFrame:
    """The states that two taxa share at each site."""
    a = cells.filter(F.col("taxon_idx") == taxon_a).select("site", F.col("mask").alias("_a"))
    b = cells.filter(F.col("taxon_idx") == taxon_b).select("site", F.col("mask").alias("_b"))
    both = F.col("_a").bitwiseAND(F.col("_b"))
    return a.join(b, "site").select("site", both.alias("shared_mask"), F.bit_count(both).cast("int").alias("n_shared"))


def expand_states(cells: DataFrame) -> DataFrame:
    """A row for each state that a cell may have (conditional likelihood 1)."""
    state = F.explode(F.sequence(F.lit(0), F.lit(SENSE - 1))).alias("state")
    return cells.select("taxon_idx", "site", "mask", state).filter(F.expr("getbit(mask, state) = 1")).select("taxon_idx", "site", "state")


def exclude(cells: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Cells outside the character set ``name``."""
    return cells.join(small(cut(sets.filter(F.col("name") == name).select(F.col("idx").alias("site")))), "site", "left_anti")


def active_count(cells: DataFrame, sets: DataFrame, names: list[str]) -> DataFrame:
    """n_active, n_sites: how many columns are left when these sets are excluded."""
    gone = cut(sets.filter(F.col("name").isin(names)).select(F.col("idx").alias("site")).distinct())
    sites = cells.select("site").distinct().join(small(gone.withColumn("_out", F.lit(True))), "site", "left")
    return sites.agg(F.count_if(F.col("_out").isNull()).alias("n_active"), F.count(F.lit(1)).alias("n_sites"))


def subset(cells: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Cells inside the taxon set and the character set ``name``; a set that isn't there keeps all."""
    for kind, column in (("taxset", "taxon_idx"), ("charset", "site")):
        own = cut(sets.filter((F.col("kind") == kind) & (F.col("name") == name)).select(F.col("idx").alias(column)).distinct())
        if not own.isEmpty():
            cells = cells.join(small(own), column, "left_semi")
    return cells


def gap_characters(sequences: DataFrame) -> DataFrame:
    """Presence (1) or absence (0) of a gap, for each taxon at each position where any has one.
    The positions with gaps are found first and sent to the letters, which don't move."""
    at = F.posexplode(pieces(F.col("seq"))).alias("pos", "ch")
    letters = lambda rows: rows.select("taxon_idx", at).select("taxon_idx", (F.col("pos") + 1).alias("pos"), (F.col("ch") == "-").cast("int").alias("gap"))
    gapped = cut(letters(sequences.filter(F.contains("seq", F.lit("-")))).filter("gap = 1").select("pos").distinct())
    return letters(sequences).join(small(gapped), "pos").select("pos", "taxon_idx", "gap")


def nucleotide_masks(sequences: DataFrame) -> DataFrame:
    """taxon_idx, pos, mask: IUPAC symbols as sets of nucleotides, null for gaps."""
    cells = sequences.select("taxon_idx", F.posexplode(pieces(F.col("seq"))).alias("pos", "ch"))
    return cells.select("taxon_idx", (F.col("pos") + 1).alias("pos"), iupac_mask(F.col("ch")).alias("mask"))


def step_matrix(n: int, ordered: bool, spark) -> DataFrame:
    """i, j, steps between n states: their distance if ordered, else 1."""
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    steps = F.abs(F.col("i") - F.col("j")) if ordered else (F.col("i") != F.col("j")).cast("int")
    return cells.withColumn("steps", steps)


def positions_in_codon(sets: DataFrame) -> DataFrame:
    """Columns of position sets 1, 2 and 3 joined by rank: site, pos1, pos2, pos3."""
    ranked = running(sets, ["position"], ["idx"], _n=F.lit(1)).withColumn("site", (F.col("_n") - 1).cast("int"))
    out = ranked.groupBy("site").pivot("position", [1, 2, 3]).agg(F.first("idx"))
    return out.select("site", *[F.col(str(k)).alias(f"pos{k}") for k in (1, 2, 3)])
