"""Round trips through the file formats: tables written, read again, and the SQL of the
same rows from the tables.

The files go to the shared checkpoint folder, one for each value of ``file``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonloom.functions.genetic import SENSE, codons
from codonloom.operators import index_sets, step_types
from codonloom.operators import trees as tr
from codonloom.operators.lineage import cut, new_path
from codonloom.plans.tree_queries import _CLOSURE, _FOREST, forest, one_tree
from codonloom.plans.tree_queries import SQL as TREE_SQL
from codonloom.sources import formats, sinks
from codonloom.sources.adapters import codon_cells, read, sequences, trace, tree_nodes, with_sql

TAXA_A_FILE = 1000


def written(rows: DataFrame) -> str:
    """The path under which the texts of rows now lie."""
    path = new_path(rows.sparkSession)
    sinks.write_text(rows, path)
    return f"{path}/*/*.txt"


def named(rows: DataFrame) -> DataFrame:
    """file is the key that was written, not the path."""
    return rows.withColumn("file", F.regexp_extract("file", r"/file=([^/]+)/", 1))


def documents(spark, d):
    """file, taxon_idx, name, seq: the letters of all documents, 1000 to a file."""
    s = sequences(spark, d)
    return s.select(
        F.concat(F.lit("part"), F.floor(F.col("taxon_idx") / TAXA_A_FILE).cast("string")).alias("file"), (F.col("taxon_idx") % TAXA_A_FILE).cast("int").alias("taxon_idx"),
        F.concat(F.lit("doc "), F.col("taxon_idx").cast("string")).alias("name"), "seq",
    )


def alignment(spark, d):
    """file, taxon_idx, name, seq: the observed codons as one alignment of 25 taxa."""
    cells = codon_cells(spark, d).join(F.broadcast(codons(spark).select("state", "codon")), "state", "left")
    by_site = F.array_sort(F.collect_list(F.struct("site", F.coalesce("codon", F.lit("???")).alias("c"))))
    rows = cells.groupBy("taxon_idx").agg(F.array_join(F.transform(by_site, lambda x: x["c"]), "").alias("seq"))
    return rows.select(F.lit("a").alias("file"), "taxon_idx", F.concat(F.lit("t"), F.col("taxon_idx").cast("string")).alias("name"), "seq")


def fasta_round_trip(spark, d):
    back = named(formats.read(spark, "dnafasta", written(sinks.fasta_lines(documents(spark, d)))))
    return back.select("file", F.row_number().over(Window.partitionBy("file").orderBy("taxon_idx")).alias("place"), "name", "seq", "datatype")


def _aligned(write, reader, spark, d):
    back = formats.read(spark, reader, written(write(alignment(spark, d))))
    return back.select("taxon_idx", "name", F.upper("seq").alias("seq"))


def phylip_round_trip(spark, d):
    return _aligned(sinks.phylip_text, "phylip", spark, d)


def phylip_relaxed_round_trip(spark, d):
    return _aligned(partial(sinks.phylip_text, relaxed=True), "phylip-relaxed", spark, d)


def phylip_interleaved_round_trip(spark, d):
    return _aligned(sinks.phylip_pages, "phylip-interleaved", spark, d)


def clustal_round_trip(spark, d):
    return _aligned(sinks.clustal_pages, "aln", spark, d)


def fin_round_trip(spark, d):
    return _aligned(sinks.fin_text, "fin", spark, d)


def nexus_codons_round_trip(spark, d):
    return _aligned(sinks.nexus_text, "nexus-codons", spark, d)


def fasta_as_nexus(spark, d):
    """FASTA turned into NEXUS, and that read as codons."""
    texts = formats.fasta_to_nexus(spark, written(sinks.fasta_lines(alignment(spark, d))))
    return formats.nexus_codons(spark, written(texts.withColumn("file", F.lit("n")))).select("taxon_idx", "name", "seq")


def alignment_shapes(spark, d):
    """Which files hold one length, and so an alignment."""
    both = alignment(spark, d).unionByName(documents(spark, d))
    return formats.alignments(named(formats.read_fasta(spark, written(sinks.fasta_lines(both)))))


def nexus_cells_round_trip(spark, d):
    cells = formats.nexus_cells(formats.nexus_matrix(formats.nexus_commands(spark, written(sinks.nexus_text(alignment(spark, d))))))
    return cells.select("taxon_idx", "char_idx", "symbol", "kind", F.array_join("states", "").alias("states"))


def nexus_taxa_round_trip(spark, d):
    taxa = tree_nodes(spark, d).filter("is_tip").select(F.lit("a").alias("file"), F.col("node_idx").alias("taxon_idx"), "name")
    return formats.nexus_taxa(formats.nexus_commands(spark, written(sinks.nexus_taxa_text(taxa)))).select("taxon_idx", "name")


def nexus_trees_round_trip(spark, d):
    """The forest, every other tree rooted, written as TREES and parsed again."""
    trees = tr.newick(forest(spark, d)).select(F.lit("a").alias("file"), "tree_id", "newick", (F.col("tree_id") % 2 == 0).alias("rooted"))
    back = cut(formats.nexus_trees(formats.nexus_commands(spark, written(sinks.nexus_trees_text(trees)))))
    nodes = tr.parse_newick(back.select("tree_id", "newick")).join(back.select("tree_id", "rooted"), "tree_id")
    return nodes.select("tree_id", "name", "is_tip", "rooted", F.round("branch_len", 6).alias("branch_len"))


def newick_notes(spark, d):
    """The comments behind the nodes, which carry the node's number."""
    notes = formats.newick_notes(tr.newick(forest(spark, d)))
    return notes.select("tree_id", F.col("label").alias("name"), "key", F.col("value").cast("int").alias("value"))


def newick_file_round_trip(spark, d):
    texts = tr.newick(one_tree(spark, d)).select(F.lit("a").alias("file"), F.col("newick").alias("value"))
    return formats.read(spark, "relaxedphyliptree", written(texts)).select(F.col("tree_id").cast("int").alias("tree_id"), "newick")


def nexus_distances_round_trip(spark, d):
    """Path lengths between the tips of every tree, a file for each tree."""
    pairs = tr.patristic(forest(spark, d)).select(F.concat(F.lit("t"), F.col("tree_id").cast("string")).alias("file"), F.col("tip_b").alias("row"), F.col("tip_a").alias("col"), F.round("dist", 6).alias("d"))
    tips = forest(spark, d).filter("is_tip").select(F.concat(F.lit("t"), F.col("tree_id").cast("string")).alias("file"), F.col("node_idx").alias("row"), "name")
    cells = pairs.unionByName(tips.select("file", "row", F.col("row").alias("col"), F.lit(0.0).alias("d"))).join(tips, ["file", "row"])
    back = named(formats.nexus_distances(formats.nexus_commands(spark, written(sinks.nexus_distances_text(cells)))))
    return back.select("file", "row", "col", "name", "d")


def nexus_unaligned_round_trip(spark, d):
    back = named(formats.nexus_unaligned(formats.nexus_commands(spark, written(sinks.nexus_unaligned_text(documents(spark, d))))))
    return back.select("file", "name", "seq")


def nexus_sets_round_trip(spark, d):
    """Sets of order numbers as ranges, written as CHARSETs, read and expanded."""
    keys = read(spark, d, "orders").select((F.col("o_custkey") % 10).cast("string").alias("name"), (F.col("o_orderkey") % 200 + 1).cast("int").alias("idx")).distinct()
    sets = index_sets.ranges(keys).select(F.lit("a").alias("file"), F.lit("charset").alias("kind"), F.concat(F.lit("set "), "name").alias("name"), "definition")
    back = formats.nexus_sets(formats.nexus_commands(spark, written(sinks.nexus_sets_text(sets))))
    return index_sets.expand(back.filter("kind = 'charset'").select("name", "definition"), 200)


def nexus_associations_round_trip(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    pairs = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.lit("a").alias("file"), F.col("r_name").alias("a"), F.col("n_name").alias("b"))  # nations: 25 rows
    return formats.nexus_associations(formats.nexus_commands(spark, written(sinks.nexus_associations_text(pairs)))).select("a", "b")


#: The cells of a code, by number; x is (01), Y is 2, 9 is no symbol of the block.
CODES = ["0", "1", "x", "Y", "{12}", "?", "-", "9"]


def mixed(spark, d) -> DataFrame:
    """The commands of a file for each region that has several blocks of a kind: its
    customers as taxa with words and codes, its nations with numbers."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    home = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")  # nations: 25 rows
    row = c.join(F.broadcast(home), c.c_nationkey == home.n_nationkey)
    key = F.col("c_custkey")
    code = [F.element_at(F.array(*map(F.lit, CODES)), (F.floor(key / k) % 8 + 1).cast("int")) for k in (1, 8, 64)]
    segment = F.when(key % 7 == 0, F.concat(F.lit("("), "c_mktsegment", F.lit(" other)"))).otherwise(F.col("c_mktsegment"))
    lines = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), x.alias("t")))), lambda v: v["t"]), "\n")
    name = F.concat(F.lit("c"), key.cast("string"))
    taxa = row.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n"), lines(name).alias("names"), lines(F.concat(name, F.lit(" "), segment, F.lit(" "), F.col("c_nationkey").cast("string"))).alias("words"),
        lines(F.concat(name, F.lit(" "), code[0], F.when(key % 2 == 0, "\n  ").otherwise(""), code[1], code[2])).alias("codes"),
    )
    by_nation = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", x.alias("t")))), lambda v: v["t"]), "\n")
    nations = home.groupBy("r_name").agg(
        F.count(F.lit(1)).alias("m"), by_nation(F.concat(F.lit("'"), "n_name", F.lit("'"))).alias("places"),
        by_nation(F.concat(F.lit("'"), "n_name", F.lit("' "), (F.col("n_nationkey") / 4.0).cast("string"), F.when(F.col("n_nationkey") % 5 == 0, " ?").otherwise(" -2e-3"))).alias("numbers"),
        by_nation(F.concat(F.lit("'n"), F.col("n_nationkey").cast("string"), F.lit("'"))).alias("labels"),
    )
    text = F.format_string(
        "#NEXUS\nBEGIN TAXA; TITLE '%s'; DIMENSIONS NTAX=%d; TAXLABELS %s; END;\nBEGIN TAXA; TITLE 'the other'; DIMENSIONS NTAX=%d; TAXLABELS %s; END;\n"
        "BEGIN CHARACTERS; TITLE words; LINK TAXA = '%s'; DIMENSIONS NCHAR=2; FORMAT DATATYPE=STANDARD TOKENS;\n CHARSTATELABELS 1 segment, 2 'home (nation)' / %s; ELIMINATE 2;\n MATRIX\n%s\n; END;\n"
        "BEGIN CHARACTERS; TITLE numbers; DIMENSIONS NCHAR=2; FORMAT DATATYPE=CONTINUOUS; MATRIX\n%s\n; END;\n"
        "BEGIN CHARACTERS; TITLE codes; LINK TAXA = '%s'; DIMENSIONS NCHAR=3; FORMAT SYMBOLS=\"0 1 2\" EQUATE=\"x=(01) Y=2\"; MATRIX\n%s\n; END;\n"
        "BEGIN NOTES; TEXT [a [nested] comment; with marks] anything 'in [quotes]; here'; END;\n",
        "r_name", "n", "names", "m", "places", "r_name", "labels", "words", "numbers", "r_name", "codes",
    )
    return named(formats.nexus_commands(spark, written(taxa.join(nations, "r_name").select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("file"), text.alias("value")))))


def nexus_block_report(spark, d):
    return formats.nexus_blocks(mixed(spark, d)).select("file", "block_idx", "block", "title", "n_commands")


def nexus_block_links(spark, d):
    return formats.nexus_links(mixed(spark, d)).select("file", "block_idx", "kind", "target_idx")


def nexus_mixed_cells(spark, d):
    """Cells of token, continuous and symbol matrices, equates followed."""
    matrix = cut(formats.nexus_matrix(mixed(spark, d)))
    cells = formats.nexus_cells(matrix).join(matrix.select("file", "block_idx", "taxon_idx", "name"), ["file", "block_idx", "taxon_idx"])
    return cells.select("block_idx", "name", "char_idx", "symbol", "kind", F.array_join("states", "|").alias("states"))


def nexus_labels(spark, d):
    c = mixed(spark, d)
    chars = formats.nexus_char_labels(c).select("file", "char_idx", F.lit(-1).alias("state_idx"), "label")
    return chars.unionByName(formats.nexus_state_labels(c).select("file", "char_idx", "state_idx", "label"))


def nexus_eliminated(spark, d):
    """Cells of the word matrices that ELIMINATE leaves."""
    c = cut(mixed(spark, d))
    gone = index_sets.expand(formats.nexus_eliminated(c).select(F.struct("file", "block_idx").alias("name"), "definition"), 2)
    gone = gone.select("name.*", (F.col("idx") - 1).cast("int").alias("char_idx"))
    cells = formats.nexus_cells(formats.nexus_matrix(c.filter("block_idx = 3")))
    left = cells.join(gone, ["file", "block_idx", "char_idx"], "left_anti")
    return left.groupBy("file", "char_idx").agg(F.count(F.lit(1)).alias("n_cells"))


def nexus_translated_trees(spark, d):
    """The forest with numbers for tips in its trees, and TRANSLATE for their names."""
    t = forest(spark, d)
    texts = tr.newick(t.withColumn("name", F.when(F.col("is_tip"), F.col("node_idx").cast("string"))), nhx=[])
    pairs = t.filter("is_tip AND tree_id = 0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_idx", "name"))), lambda x: F.concat(x["node_idx"].cast("string"), F.lit(" '"), x["name"], F.lit("'"))), ", ").alias("p"))
    trees = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tree_id", "newick"))), lambda x: F.concat(F.lit("TREE t"), x["tree_id"].cast("string"), F.lit(" = "), x["newick"])), "\n").alias("t"))
    text = F.concat(F.lit("#NEXUS\nBEGIN TREES; TRANSLATE "), "p", F.lit(";\n"), "t", F.lit("\nEND;\n"))
    back = formats.nexus_trees(formats.nexus_commands(spark, written(pairs.join(trees, F.lit(True)).select(F.lit("a").alias("file"), text.alias("value")))))  # one row each
    tips = tr.parse_newick(cut(back.select("tree_id", "newick"))).filter("is_tip")
    return tips.select("tree_id", "name", F.round("branch_len", 6).alias("branch_len"))


def listed_files(spark, d):
    """FASTA files that the lines of a text file name."""
    path = written(sinks.fasta_lines(documents(spark, d)))
    names = new_path(spark)
    spark.read.text(path).select(F.input_file_name().alias("value")).distinct().write.text(names)
    back = named(formats.read_listed(spark, "fasta", names))
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("n_letters"))


def usertype_changes(spark, d):
    """A USERTYPE whose states are a tree (state k under (k - 1) / 2), written and read, and
    by its shortest ways the changes between each two taxa."""

    def text(k):
        below = [text(j) for j in (2 * k + 1, 2 * k + 2) if j < SENSE]
        return (f"({','.join(below)})" if below else "") + str(k)

    block = f"#NEXUS\nBEGIN ASSUMPTIONS;\n USERTYPE heap (CSTREE) = {text(0)};\nEND;\n"
    types = formats.nexus_usertypes(formats.nexus_commands(spark, written(spark.createDataFrame([("u", block)], "file string, value string"))))
    steps = step_types.shortest_steps(step_types.tree_edges(types.select("name", F.concat("definition", F.lit(";")).alias("newick"))))
    cells = codon_cells(spark, d).select("taxon_idx", "site", F.col("state").cast("string").alias("state"))
    return step_types.weighted_changes(cells, steps)


def trace_table_round_trip(spark, d):
    """The trace as tab-separated columns, a folder for each chain, and long again."""
    long = trace(spark, d)
    names = [r.param for r in long.select("param").distinct().orderBy("param").collect()]  # kinds of events
    path = new_path(spark)
    sinks.write_trace_table(long, names, path)
    return formats.read_trace_table(spark, path).select("iteration", "chain", "param", "value")


def safe_names(spark, d):
    taxa = tree_nodes(spark, d).filter("is_tip").select(F.col("node_idx").alias("taxon_idx"), "name")
    return sinks.safe_names(taxa)


def site_columns(spark, d):
    """Per-site values as parameters ``name[site]``, as the columns of a trace."""
    rows = read(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("iteration"), F.lit(0).alias("chain"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("site"), F.round("c_acctbal", 2).alias("value"))
    return sinks.cell_columns(rows, "name").select("iteration", "param", "value")


QUERIES = {
    f.__name__: f
    for f in (
        fasta_round_trip, phylip_round_trip, phylip_relaxed_round_trip, phylip_interleaved_round_trip, clustal_round_trip, fin_round_trip, nexus_codons_round_trip,
        fasta_as_nexus, alignment_shapes, nexus_cells_round_trip, nexus_taxa_round_trip, nexus_trees_round_trip, newick_notes, newick_file_round_trip,
        nexus_distances_round_trip, nexus_unaligned_round_trip, nexus_sets_round_trip, nexus_associations_round_trip, nexus_block_report, nexus_block_links,
        nexus_mixed_cells, nexus_labels, nexus_eliminated, nexus_translated_trees, listed_files, usertype_changes, trace_table_round_trip, safe_names, site_columns,
    )
}

_DOCS = with_sql("sequences") + """,
docs AS (SELECT 'part' || CAST(taxon_idx // 1000 AS VARCHAR) file, taxon_idx % 1000 taxon_idx, 'doc ' || CAST(taxon_idx AS VARCHAR) AS name, seq FROM sequences)"""
_ALIGNED = with_sql("codons", "codon_cells") + """,
aligned AS (SELECT c.taxon_idx, 't' || CAST(c.taxon_idx AS VARCHAR) AS name, string_agg(coalesce(k.codon, '???'), '' ORDER BY c.site) seq
  FROM codon_cells c LEFT JOIN codons k ON k.state = c.state GROUP BY c.taxon_idx)"""
_SAME = _ALIGNED + " SELECT taxon_idx, name, seq FROM aligned"

SQL = {
    "fasta_round_trip": _DOCS + " SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY taxon_idx) AS INT) place, name, seq, 'dna' datatype FROM docs",
    **dict.fromkeys(
        ("phylip_round_trip", "phylip_relaxed_round_trip", "phylip_interleaved_round_trip", "clustal_round_trip", "fin_round_trip", "nexus_codons_round_trip", "fasta_as_nexus"), _SAME
    ),
    "alignment_shapes": _ALIGNED + "," + _DOCS.removeprefix("WITH RECURSIVE") + """
      SELECT 'a' file, count(*) n_taxa, max(length(seq)) n_char, true aligned FROM aligned
      UNION ALL SELECT file, count(*), max(length(seq)), min(length(seq)) = max(length(seq)) FROM docs GROUP BY file""",
    "nexus_cells_round_trip": _ALIGNED + """,
      cells AS (SELECT taxon_idx, unnest(range(length(seq))) char_idx, unnest(string_split(seq, '')) symbol FROM aligned)
      SELECT taxon_idx, CAST(char_idx AS INT) char_idx, symbol, CASE WHEN symbol = '?' THEN 'missing' ELSE 'state' END kind, CASE WHEN symbol = '?' THEN '' ELSE symbol END states FROM cells""",
    "nexus_taxa_round_trip": "SELECT CAST(n_nationkey AS INT) taxon_idx, n_name AS name FROM nation",
    "nexus_trees_round_trip": _FOREST + " SELECT tree_id, name, is_tip, tree_id % 2 = 0 rooted, round(branch_len, 6) branch_len FROM forest",
    "newick_notes": _FOREST + " SELECT tree_id, name, 'index' AS key, node_idx AS value FROM forest",
    "newick_file_round_trip": TREE_SQL["newick_text"],
    "nexus_distances_round_trip": _FOREST + _CLOSURE + """,
      tip AS (SELECT up.* FROM up JOIN forest f ON f.tree_id = up.tree_id AND f.node_idx = up.descn AND f.is_tip),
      both_ AS (SELECT a.tree_id, a.descn tip_a, b.descn tip_b, a.hops + b.hops edges, a.dist + b.dist dist
        FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.anc = b.anc AND a.descn <= b.descn),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id, tip_a, tip_b ORDER BY edges) r FROM both_)
      SELECT 't' || CAST(k.tree_id AS VARCHAR) file, k.tip_b "row", k.tip_a col, f.name, round(k.dist, 6) d
      FROM ranked k JOIN forest f ON f.tree_id = k.tree_id AND f.node_idx = k.tip_b WHERE k.r = 1""",
    "nexus_unaligned_round_trip": _DOCS + " SELECT file, name, seq FROM docs",
    "nexus_sets_round_trip": "SELECT DISTINCT 'set ' || CAST(o_custkey % 10 AS VARCHAR) AS name, CAST(o_orderkey % 200 + 1 AS INT) idx FROM orders",
    "nexus_associations_round_trip": "SELECT r_name a, n_name b FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nexus_block_report": """
      WITH b(block_idx, block, title, n_commands) AS (VALUES (1, 'TAXA', '', 3), (2, 'TAXA', 'the other', 3), (3, 'CHARACTERS', 'words', 7), (4, 'CHARACTERS', 'numbers', 4), (5, 'CHARACTERS', 'codes', 5), (6, 'NOTES', NULL, 1))
      SELECT replace(r_name, ' ', '_') file, block_idx, block, CASE WHEN title = '' THEN r_name ELSE title END title, n_commands FROM b, region WHERE r_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "nexus_block_links": """
      WITH b(block_idx, kind, target_idx) AS (VALUES (3, 'TAXA', 1), (4, 'TAXA', 2), (5, 'TAXA', 1), (6, 'TAXA', 2))
      SELECT replace(r_name, ' ', '_') file, block_idx, kind, target_idx FROM b, region WHERE r_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "nexus_mixed_cells": """
      WITH code(i, symbol, kind, states) AS (VALUES (0, '0', 'state', '0'), (1, '1', 'state', '1'), (2, 'x', 'uncertain', '0|1'), (3, 'Y', 'state', '2'), (4, '12', 'uncertain', '1|2'), (5, '?', 'missing', ''), (6, '-', 'gap', ''), (7, '9', 'unknown', '9')),
      used AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey))
      SELECT 3 block_idx, 'c' || CAST(c_custkey AS VARCHAR) AS name, 0 char_idx, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' other' ELSE c_mktsegment END symbol,
        CASE WHEN c_custkey % 7 = 0 THEN 'polymorphic' ELSE 'state' END kind, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || '|other' ELSE c_mktsegment END states FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 3, 'c' || CAST(c_custkey AS VARCHAR), 1, CAST(c_nationkey AS VARCHAR), 'state', CAST(c_nationkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 4, n_name, 0, CAST(n_nationkey / CAST(4 AS DOUBLE) AS VARCHAR), 'state', CAST(n_nationkey / CAST(4 AS DOUBLE) AS VARCHAR) FROM used
      UNION ALL SELECT 4, n_name, 1, CASE WHEN n_nationkey % 5 = 0 THEN '?' ELSE '-2e-3' END, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' ELSE 'state' END, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '-2e-3' END FROM used
      UNION ALL SELECT 5, 'c' || CAST(c_custkey AS VARCHAR), k.c, symbol, kind, states FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES (0, 1), (1, 8), (2, 64)) k(c, p) JOIN code ON i = c_custkey // p % 8""",
    "nexus_labels": """
      WITH n AS (SELECT replace(r_name, ' ', '_') file, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey))
      SELECT DISTINCT file, 0 char_idx, -1 state_idx, 'segment' AS label FROM n UNION ALL SELECT DISTINCT file, 1, -1, 'home (nation)' FROM n
      UNION ALL SELECT file, 1, CAST(row_number() OVER (PARTITION BY file ORDER BY n_nationkey) - 1 AS INT), 'n' || CAST(n_nationkey AS VARCHAR) FROM n""",
    "nexus_eliminated": """
      SELECT replace(r_name, ' ', '_') file, 0 char_idx, count(*) n_cells FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "nexus_translated_trees": _FOREST + " SELECT tree_id, name, round(branch_len, 6) branch_len FROM forest WHERE is_tip",
    "listed_files": _DOCS + " SELECT file, count(*) n, CAST(sum(length(seq)) AS BIGINT) n_letters FROM docs GROUP BY file",
    "usertype_changes": with_sql("codon_cells") + """,
      h AS (SELECT range s, range a, 0 hops FROM range(61) UNION ALL SELECT s, (a - 1) // 2, hops + 1 FROM h WHERE a > 0),
      w AS (SELECT x.s i, y.s j, min(x.hops + y.hops) steps FROM h x JOIN h y ON x.a = y.a GROUP BY x.s, y.s)
      SELECT a.taxon_idx taxon_a, b.taxon_idx taxon_b, count(*) n_sites, CAST(sum(steps) AS DOUBLE) steps, CAST(0 AS BIGINT) n_barred
      FROM codon_cells a JOIN codon_cells b ON a.site = b.site AND a.taxon_idx < b.taxon_idx JOIN w ON w.i = a.state AND w.j = b.state GROUP BY a.taxon_idx, b.taxon_idx""",
    "trace_table_round_trip": with_sql("trace") + " SELECT iteration, chain, param, round(value, 6) AS value FROM trace WHERE value IS NOT NULL",
    "safe_names": "SELECT n_name AS name, 't' || CAST(n_nationkey AS VARCHAR) safe_name FROM nation",
    "site_columns": "SELECT c_custkey % 1000 iteration, c_mktsegment || '[' || CAST(c_custkey AS VARCHAR) || ']' param, round(c_acctbal, 2) AS value FROM customer",
}
