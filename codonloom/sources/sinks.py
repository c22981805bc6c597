"""Writers: traces as tables of text, alignments and trees in their file formats.

Text writers take one row per file part from an aggregate and write it with the text
sink, so each task writes its own keys; Parquet is the primary format for traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: str) -> Column:
    """Six decimals, as trace files have them; null stays null."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double"))).alias(c)


def write_trace(trace: DataFrame, path: str) -> None:
    """Long traces as Parquet, a folder for each chain."""
    trace.write.mode("overwrite").partitionBy("chain").parquet(path)


def write_trace_table(trace: DataFrame, params: list[str], path: str) -> None:
    """Tab-separated: Iteration and a column for each parameter, a folder for each chain."""
    wide = trace.groupBy("chain", F.col("iteration").alias("Iteration")).pivot("param", params).agg(F.first("value"))
    table = wide.select("chain", "Iteration", *[fixed(f"`{p}`").alias(p) if "." in p else fixed(p) for p in params])
    ordered = table.repartition("chain").sortWithinPartitions("chain", "Iteration")
    ordered.write.mode("overwrite").partitionBy("chain").option("header", True).option("sep", "\t").csv(path)


def cell_columns(cells: DataFrame, label: str) -> DataFrame:
    """iteration, chain, param, value for per-site values: the parameter is ``label[site]``."""
    return cells.select("iteration", "chain", F.concat(F.col(label).cast("string"), F.lit("["), F.col("site").cast("string"), F.lit("]")).alias("param"), "value")


def write_truth(truth: DataFrame, path: str) -> None:
    """True parameters of simulations, a folder for each replicate."""
    truth.write.mode("overwrite").partitionBy("replicate").option("header", True).option("sep", "\t").csv(path)


def fasta_lines(sequences: DataFrame, width: int = 70) -> DataFrame:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select("file", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped).alias("value"), "taxon_idx")


def phylip_text(sequences: DataFrame, relaxed: bool = False) -> DataFrame:
    """file, value: the whole file of each alignment."""
    name = F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit(" ")) if relaxed else F.rpad("name", 10, " ")
    rows = F.array_sort(F.collect_list(F.struct("taxon_idx", F.concat(name, F.col("seq")).alias("l"))))
    head = F.concat_ws(" ", F.count(F.lit(1)), F.max(F.length("seq")))
    return sequences.groupBy("file").agg(F.concat(head, F.lit("\n"), F.array_join(F.transform(rows, lambda x: x["l"]), "\n")).alias("value"))


def quoted(name: Column) -> Column:
    """A NEXUS word, in quotes where it needs them."""
    return F.when(name.rlike(r"^[A-Za-z0-9.]+$"), name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def nexus_text(sequences: DataFrame, datatype: str = "dna") -> DataFrame:
    """file, value: a TAXA and a CHARACTERS block for each alignment."""
    rows = F.array_sort(F.collect_list(F.struct("taxon_idx", quoted(F.col("name")).alias("n"), "seq")))
    n, k = F.count(F.lit(1)).cast("string"), F.max(F.length("seq")).cast("string")
    names, matrix = F.array_join(F.transform(rows, lambda x: x["n"]), " "), F.array_join(F.transform(rows, lambda x: F.concat(x["n"], F.lit(" "), x["seq"])), "\n")
    parts = (
        F.lit("#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX="), n, F.lit(";\nTAXLABELS "), names, F.lit(";\nEND;\nBEGIN CHARACTERS;\nDIMENSIONS NCHAR="), k,
        F.lit(f";\nFORMAT DATATYPE={datatype} MISSING=? GAP=-;\nMATRIX\n"), matrix, F.lit("\n;\nEND;"),
    )
    return sequences.groupBy("file").agg(F.concat(*parts).alias("value"))


def block_text(rows: DataFrame, block: str, order: list[str], line: Column, between: str = "\n", before: Column | None = None, after: str = "") -> DataFrame:
    """file, value: a NEXUS text of one block, a line for each row in order."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(lines, lambda x: x["_line"]), between)
    head = F.lit("") if before is None else before
    return rows.groupBy("file").agg(F.concat(F.lit(f"#NEXUS\nBEGIN {block};\n"), head, body, F.lit(f"{after}\nEND;")).alias("value"))


def nexus_taxa_text(taxa: DataFrame) -> DataFrame:
    """file, value: a TAXA block from (file, taxon_idx, name)."""
    head = F.concat(F.lit("DIMENSIONS NTAX="), F.count(F.lit(1)).cast("string"), F.lit(";\nTAXLABELS\n"))
    return block_text(taxa, "TAXA", ["taxon_idx"], quoted(F.col("name")), before=head, after=";")


def nexus_trees_text(trees: DataFrame) -> DataFrame:
    """file, value: a TREES block from (file, tree_id, newick) and, where there is one,
    rooted, which becomes [&R] or [&U]."""
    mark = F.when(F.col("rooted"), "[&R] ").when(~F.col("rooted"), "[&U] ").otherwise("") if "rooted" in trees.columns else F.lit("")
    return block_text(trees, "TREES", ["tree_id"], F.concat(F.lit("TREE t"), F.col("tree_id").cast("string"), F.lit(" = "), mark, F.col("newick")))


def nexus_distances_text(distances: DataFrame) -> DataFrame:
    """file, value: a DISTANCES block from the cells (file, row, name, col, d) of a lower
    triangle with its diagonal; a null d is missing."""
    cells = F.array_sort(F.collect_list(F.struct("col", F.coalesce(F.col("d").cast("string"), F.lit("?")).alias("d"))))
    rows = distances.groupBy("file", "row", "name").agg(F.array_join(F.transform(cells, lambda x: x["d"]), " ").alias("cells"))
    return block_text(rows, "DISTANCES", ["row"], F.concat_ws(" ", quoted(F.col("name")), "cells"), before=F.lit("FORMAT TRIANGLE=LOWER MISSING=?;\nMATRIX\n"), after="\n;")


def nexus_unaligned_text(sequences: DataFrame, datatype: str = "dna") -> DataFrame:
    """file, value: an UNALIGNED block from (file, taxon_idx, name, seq)."""
    return block_text(sequences, "UNALIGNED", ["taxon_idx"], F.concat_ws(" ", quoted(F.col("name")), "seq"), ",\n", F.lit(f"FORMAT DATATYPE={datatype} MISSING=? GAP=-;\nMATRIX\n"), "\n;")


def nexus_sets_text(sets: DataFrame) -> DataFrame:
    """file, value: a SETS block from (file, kind, name, definition)."""
    line = F.concat(F.upper("kind"), F.lit(" "), quoted(F.col("name")), F.lit(" = "), F.col("definition"), F.lit(";"))
    return block_text(sets, "SETS", ["kind", "name"], line)


def nexus_associations_text(pairs: DataFrame) -> DataFrame:
    """file, value: a TAXAASSOCIATION block from (file, a, b)."""
    linked = F.array_join(F.array_sort(F.collect_list(quoted(F.col("b")))), " ")
    rows = pairs.groupBy("file", "a").agg(linked.alias("bs"))
    return block_text(rows, "TAXAASSOCIATION", ["a"], F.concat(quoted(F.col("a")), F.lit(" / "), F.col("bs")), ",\n", F.lit("ASSOCIATES\n"), ";")


def paged_text(sequences: DataFrame, width: int, head: Column, label: Column) -> DataFrame:
    """file, value: interleaved pages of width characters under a first line, each line
    beginning with its label. Interleaved PHYLIP labels the first page only."""
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / width)).cast("int")), lambda k: F.struct(k.alias("page"), F.substring(F.col("seq"), k * width + 1, F.lit(width)).alias("part")))
    rows = sequences.select("file", "taxon_idx", "name", "seq", F.explode(pages).alias("x")).select("file", "taxon_idx", "name", "seq", "x.*")
    lines = F.array_sort(F.collect_list(F.struct("page", "taxon_idx", F.concat(label, "part").alias("l"))))
    return rows.groupBy("file").agg(F.concat(head, F.lit("\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.when((x["taxon_idx"] == 0) & (x["page"] > 0), "\n").otherwise(""), x["l"])), "\n")).alias("value"))


def phylip_pages(sequences: DataFrame, width: int = 60) -> DataFrame:
    """file, value: interleaved strict PHYLIP."""
    head = F.concat_ws(" ", F.count_distinct("taxon_idx"), F.max(F.length("seq")))
    return paged_text(sequences, width, head, F.rpad(F.when(F.col("page") == 0, F.col("name")).otherwise(""), 10, " "))


def clustal_pages(sequences: DataFrame, width: int = 60) -> DataFrame:
    """file, value: Clustal pages; names have no blanks."""
    return paged_text(sequences, width, F.lit("CLUSTAL W\n\n"), F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("  ")))


def fin_text(sequences: DataFrame) -> DataFrame:
    """file, value: a line for each taxon under ``label data``."""
    rows = F.array_sort(F.collect_list(F.struct("taxon_idx", F.concat_ws(" ", F.replace("name", F.lit(" "), F.lit("_")), "seq").alias("l"))))
    return sequences.groupBy("file").agg(F.concat(F.lit("label data\n"), F.array_join(F.transform(rows, lambda x: x["l"]), "\n"), F.lit("\n@\n")).alias("value"))


def safe_names(taxa: DataFrame) -> DataFrame:
    """name, safe_name: names that any format takes, ten characters at most, distinct."""
    return taxa.select("name", F.concat(F.lit("t"), F.col("taxon_idx").cast("string")).alias("safe_name"))


def write_text(rows: DataFrame, path: str) -> None:
    """One folder a file key, the text in it in order of taxon where there is one."""
    order = [c for c in ("taxon_idx",) if c in rows.columns]
    rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
