"""Codons, genetic codes and character states as columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGT"
#: The standard genetic code over codons AAA, AAC, AAG, ... TTT; * is a stop. (fixed value)
STANDARD = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
#: Other genetic codes by the codons that differ from the standard one. (fixed values)
CHANGES = {
    "standard": {},
    "vertebrate_mitochondrial": {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    "yeast_mitochondrial": {"ATA": "M", "CTA": "T", "CTC": "T", "CTG": "T", "CTT": "T", "TGA": "W"},
    "mold_mitochondrial": {"TGA": "W"},
    "invertebrate_mitochondrial": {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    "ciliate_nuclear": {"TAA": "Q", "TAG": "Q"},
    "echinoderm_mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    "euplotid_nuclear": {"TGA": "C"},
    "bacterial_plastid": {},
    "alternative_yeast_nuclear": {"CTG": "S"},
    "ascidian_mitochondrial": {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    "alternative_flatworm_mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    "blepharisma_nuclear": {"TAG": "Q"},
    "chlorophycean_mitochondrial": {"TAG": "L"},
    "trematode_mitochondrial": {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    "scenedesmus_mitochondrial": {"TCA": "*", "TAG": "L"},
    "thraustochytrium_mitochondrial": {"TTA": "*"},
}
#: IUPAC nucleotide codes as the states they stand for. (fixed values)
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT", "X": "ACGT",
}
SENSE = 61
#: All 61 sense codons possible: missing data.
ALL = (1 << SENSE) - 1


def amino_acids(code: str = "standard") -> dict[str, str]:
    codons = [a + b + c for a in NUCLEOTIDES for b in NUCLEOTIDES for c in NUCLEOTIDES]
    return dict(zip(codons, STANDARD, strict=True)) | CHANGES[code]


def sense_codons(code: str = "standard") -> list[str]:
    return [c for c, a in amino_acids(code).items() if a != "*"]


def codons(spark: SparkSession, code: str = "standard") -> DataFrame:
    """state, codon, aa: the sense codons in lexicographic order."""
    aa = amino_acids(code)
    return spark.createDataFrame([(i, c, aa[c]) for i, c in enumerate(sense_codons(code))], "state int, codon string, aa string")


def genetic_codes(spark: SparkSession) -> DataFrame:
    """code, codon, aa for all 17 codes."""
    return spark.createDataFrame([(k, c, a) for k in CHANGES for c, a in amino_acids(k).items()], "code string, codon string, aa string")


def is_transition(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("AG", "GA", "CT", "TC")


def codon_pairs(table: DataFrame) -> DataFrame:
    """i < j for codons one nucleotide apart: from, to, is_transition, is_synonymous."""
    a, b = table.alias("a"), table.alias("b")
    at = [F.substring("a.codon", k, 1) for k in (1, 2, 3)], [F.substring("b.codon", k, 1) for k in (1, 2, 3)]
    differ = [(x != y).cast("int") for x, y in zip(*at, strict=True)]
    x, y = (F.coalesce(*[F.when(p != q, r) for p, q, r in zip(*at, side, strict=True)]) for side in at)
    return a.join(b, (F.col("a.state") < F.col("b.state")) & (sum(differ[1:], differ[0]) == 1)).select(
        F.col("a.state").alias("i"), F.col("b.state").alias("j"), F.col("a.codon").alias("codon_i"), F.col("b.codon").alias("codon_j"),
        is_transition(x, y).alias("is_transition"), (F.col("a.aa") == F.col("b.aa")).alias("is_synonymous"),
    )


def state_mask(state: Column) -> Column:
    """The mask of a codon state; null is missing data, every state."""
    return F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), state.cast("int")), F.lit(ALL))


def iupac_mask(symbol: Column) -> Column:
    """A, C, G, T as bits 0 to 3; gaps and unknown symbols are null."""
    out = F.lit(None).cast("int")
    for s, states in IUPAC.items():
        out = F.when(F.upper(symbol) == s, F.lit(sum(1 << NUCLEOTIDES.index(x) for x in states))).otherwise(out)
    return out
