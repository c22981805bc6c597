import pytest
from pyspark.sql import functions as F

from codonloom.sources import formats, sinks


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">alpha one\nACG\nTA-\n\n>beta\r\nACGTTT\n>alpha one\nA\n")
    assert rows(formats.read(spark, "fasta", p), "taxon_idx", "name", "seq") == [(0, "alpha one", "ACGTA-"), (1, "beta", "ACGTTT"), (2, "alpha one", "A")]


def test_phylip(spark, tmp_path):
    want = [(0, "tax a", "ACGTAC"), (1, "taxb", "TTTTTT")]
    p = put(tmp_path, "s.phy", " 2 6\ntax a     ACG\n TAC\ntaxb      TTT TTT\n")
    assert rows(formats.read(spark, "phylip", p), "taxon_idx", "name", "seq") == want
    p = put(tmp_path, "i.phy", "2 6\ntax a     ACG\ntaxb      TTT\n\n TAC\n TTT\n")
    assert rows(formats.read(spark, "phylip-interleaved", p), "taxon_idx", "name", "seq") == want
    p = put(tmp_path, "r.phy", "2 6\na_long_name_here ACG\nTAC\nb TTTTTT\n")
    assert rows(formats.read(spark, "phylip-relaxed", p), "name", "seq") == [("a_long_name_here", "ACGTAC"), ("b", "TTTTTT")]
    bad = put(tmp_path, "bad.phy", "3 6\na ACGTAC\nb TTTTTT\n")
    with pytest.raises(Exception, match="counts"):
        formats.read(spark, "phylip-relaxed", bad).collect()


def test_clustal(spark, tmp_path):
    p = put(tmp_path, "c.aln", "CLUSTAL W (1.8)\n\n\none  ACG-\ntwo  ACGT 4\n     *** \n\none  TT\ntwo  TA\n     * \n")
    assert rows(formats.read(spark, "aln", p), "taxon_idx", "name", "seq") == [(0, "one", "ACG-TT"), (1, "two", "ACGTTA")]


def test_fin(spark, tmp_path):
    p = put(tmp_path, "f.fin", "Label Data\n/* a\ncomment */\nA_x AC GT\nb [AG]C-?\n@ rest\nc AAAA\n")
    assert rows(formats.read(spark, "fin", p), "taxon_idx", "name", "seq") == [(0, "A x", "ACGT"), (1, "b", "{AG}C-?")]
    with pytest.raises(Exception, match="label data"):
        formats.read(spark, "fin", put(tmp_path, "g.fin", "nothing\nb AC\n")).collect()


NEXUS = """#NEXUS
[a comment; with marks]
BEGIN TAXA; DIMENSIONS NTAX=3; TAXLABELS A_one 'B''s; two' C; END;
BEGIN CHARACTERS;
 DIMENSIONS NCHAR=6;
 FORMAT DATATYPE=DNA MISSING=? GAP=- MATCHCHAR=. INTERLEAVE;
 MATRIX
 A_one ACG
 'B''s; two' ..T
 C {AG}?-

 A_one TTT
 'B''s; two' ...
 C (AC)GA
 ;
END;
BEGIN TREES; TRANSLATE 1 A_one, 2 'B''s; two', 3 C; TREE * best = [&U] ((1:0.1,2:.2)x:0.3,3); TREE other=(1,2,3); END;
BEGIN SETS; CHARSET early = 1-3; TAXSET 'my set' = A_one C; CHARPARTITION cod = p1: 1-.\\3, p2: 2-.\\3; END;
BEGIN DISTANCES; FORMAT TRIANGLE=LOWER NODIAGONAL; MATRIX
 a
 b 1.5
 c 2 ?
 ; END;
BEGIN UNALIGNED; MATRIX a ACGT, b A C; END;
BEGIN TAXAASSOCIATION; ASSOCIATES A_one / x y, C / z; END;
BEGIN MINE; WORDS some tokens; END;
"""


def test_nexus(spark, tmp_path):
    c = formats.read(spark, "nexus", put(tmp_path, "n.nex", NEXUS)).cache()
    assert rows(formats.nexus_taxa(c), "taxon_idx", "name") == [(0, "A one"), (1, "B's; two"), (2, "C")]
    m = formats.nexus_matrix(c)
    assert rows(m, "taxon_idx", "seq", "datatype") == [(0, "ACGTTT", "dna"), (1, "ACTTTT", "dna"), (2, "{AG}?-(AC)GA", "dna")]
    cells = formats.nexus_cells(m).filter("taxon_idx = 2")
    assert rows(cells, "char_idx", "symbol", "kind") == [(0, "AG", "uncertain"), (1, "?", "missing"), (2, "-", "gap"), (3, "AC", "polymorphic"), (4, "G", "state"), (5, "A", "state")]
    want = [(0, "best", "((A_one:0.1,'B''s; two':.2)x:0.3,C);"), (1, "other", "(A_one,'B''s; two',C);")]
    assert rows(formats.nexus_trees(c), "tree_id", "tree_name", "newick") == want
    assert rows(formats.nexus_sets(c), "kind", "name", "definition") == [("charpartition", "cod", "p1: 1-.\\3, p2: 2-.\\3"), ("charset", "early", "1-3"), ("taxset", "my set", "A_one C")]
    assert rows(formats.nexus_distances(c), "row", "col", "d") == [(1, 0, 1.5), (2, 0, 2.0), (2, 1, None)]
    assert rows(formats.nexus_unaligned(c), "name", "seq") == [("a", "ACGT"), ("b", "AC")]
    assert rows(formats.nexus_associations(c), "a", "b") == [("A one", "x"), ("A one", "y"), ("C", "z")]
    assert c.filter("block = 'MINE'").select("command", "body").first() == ("WORDS", "some tokens")
    with pytest.raises(Exception, match="character block"):
        formats.nexus_codons(spark, str(tmp_path / "n.nex")).collect()


def test_round_trips(spark, tmp_path):
    seqs = spark.createDataFrame([("f1", 0, "A x", "ACGTAA"), ("f1", 1, "B", "ACG---"), ("f2", 0, "C", "TTTTTTTTT"), ("f2", 1, "D", "TTATTTTTT")], "file string, taxon_idx int, name string, seq string")
    sinks.write_text(sinks.nexus_text(seqs), str(tmp_path / "nex"))
    back = formats.nexus_codons(spark, str(tmp_path / "nex" / "*" / "*.txt"))
    assert rows(back, "name", "seq") == rows(seqs, "name", "seq")
    sinks.write_text(sinks.fasta_lines(seqs, 4), str(tmp_path / "fa"))
    assert rows(formats.read_fasta(spark, str(tmp_path / "fa" / "*" / "*.txt")), "name", "seq") == rows(seqs, "name", "seq")
    sinks.write_text(sinks.phylip_text(seqs), str(tmp_path / "phy"))
    assert rows(formats.read_phylip(spark, str(tmp_path / "phy" / "*" / "*.txt")), "name", "seq") == rows(seqs, "name", "seq")
    trees = spark.createDataFrame([("t", 0, "(a:1.0,b:2.0);"), ("t", 1, "(b,a);")], "file string, tree_id int, newick string")
    sinks.write_text(sinks.nexus_trees_text(trees), str(tmp_path / "tre"))
    again = formats.nexus_trees(formats.nexus_commands(spark, str(tmp_path / "tre" / "*" / "*.txt")))
    assert rows(again, "tree_id", "newick") == rows(trees, "tree_id", "newick")
    assert rows(formats.read_newick(spark, put(tmp_path, "n.tre", "(a, b);\n(b,\na:1);\n")), "tree_id", "newick") == [(0, "(a,b);"), (1, "(b,a:1);")]
    assert rows(sinks.safe_names(seqs), "safe_name")[0] == ("t0",)


def test_trace_table(spark, tmp_path):
    t = spark.createDataFrame([(i, c, p, i + 0.5) for i in range(3) for c in (0, 1) for p in ("K", "Omega")], "iteration long, chain int, param string, value double")
    sinks.write_trace_table(t, ["K", "Omega"], str(tmp_path / "tsv"))
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv"))
    assert rows(back.filter("chain = 0"), "Iteration", "K") == [("0", "0.500000"), ("1", "1.500000"), ("2", "2.500000")]
    again = formats.read_trace_table(spark, str(tmp_path / "tsv"))
    assert rows(again.filter("chain = 1 AND param = 'Omega'"), "iteration", "value") == [(0, 0.5), (1, 1.5), (2, 2.5)]
    sinks.write_trace(t, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 12
    sites = t.select("iteration", "chain", F.lit("tip").alias("name"), F.lit(4).alias("site"), "value")
    assert sinks.cell_columns(sites, "name").select("param").first()[0] == "tip[4]"


def test_large_files(spark, tmp_path):
    """Matrices longer than a pattern may recurse, and FASTA read in many blocks."""
    seq = "ACGT" * 50_000
    p = put(tmp_path, "long.nex", f"#NEXUS\nBEGIN DATA;\nDIMENSIONS NCHAR={len(seq)};\nFORMAT DATATYPE=DNA;\nMATRIX\n'a''b' {seq}\nc\n{seq[:1000]}\n{seq[1000:]}\n;\nEND;\n")
    assert rows(formats.nexus_matrix(formats.nexus_commands(spark, p)), "taxon_idx", "name", "seq") == [(0, "a'b", seq), (1, "c", seq)]
    want = [(i, f"n{i} >x", "ACGT" * (i % 7)) for i in range(3000)]
    p = put(tmp_path, "many.fa", "; no record\n" + "".join(f">{n}\n{s[:9]}\n{s[9:]}\n" for _, n, s in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = formats.read_fasta(spark, p)
        assert formats.records(spark, p).select("block").distinct().count() > 5
        assert rows(found, "taxon_idx", "name", "seq") == want
        phylip = put(tmp_path, "many.phy", "900 12\n" + "".join(f"n{i:<9}ACGT\n\nACGT ACGT\n" for i in range(900)))
        assert rows(formats.read_phylip(spark, phylip), "taxon_idx", "name", "seq") == [(i, f"n{i}", "ACGT" * 3) for i in range(900)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_format_names(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">a\nAC\n>b\nACGT\n")
    assert rows(formats.read(spark, "aafasta", p), "name", "datatype") == [("a", "protein"), ("b", "protein")]
    assert rows(formats.alignments(formats.read_fasta(spark, p)), "n_taxa", "n_char", "aligned") == [(2, 4, False)]
    with pytest.raises(ValueError, match="format"):
        formats.read(spark, "discretefasta", p)
    listed = put(tmp_path, "list.txt", f"{p}\n\n{put(tmp_path, 'b.fa', '>c' + chr(10) + 'A')}\n")
    assert rows(formats.read_listed(spark, "fasta", listed), "name", "seq") == [("a", "AC"), ("b", "ACGT"), ("c", "A")]
    q = put(tmp_path, "q.tre", "[&U] ('a; b' , c [&x=1] ) ;\n(c,'it''s');")
    assert rows(formats.read_newick(spark, q), "tree_id", "newick") == [(0, "[&U]('a; b',c[&x=1]);"), (1, "(c,'it''s');")]
    notes = spark.createDataFrame([(0, "('a b'[&&NHX:S=x y:E=1.1]:1,c:2[&r=3,k={1}])d;")], "tree_id int, newick string")
    assert rows(formats.newick_notes(notes), "label", "key", "value") == [("a b", "E", "1.1"), ("a b", "S", "x y"), ("c", "k", "{1}"), ("c", "r", "3")]


def test_commands_leave_a_task_text_by_text(spark, tmp_path):
    from codonloom.functions import comments
    from codonloom.sources.formats import nexus_commands

    texts = [("a", "x [c] y; 'p;q' [&k]z;rest"), ("b", None), ("c", ""), ("d", "m;n;"), ("e", "A" * (comments.SENT + 1) + ";" + "B;" * 3)]
    got = {tuple(r) for r in comments.command_rows(spark.createDataFrame(texts, "file string, text string").coalesce(1), "notes").collect()}
    assert got == {(f, k, *p) for f, t in texts if t for k, p in enumerate(comments.pieces(t, "notes"))} and len(got) == 9
    (tmp_path / "a.nex").write_text("#NEXUS BEGIN TAXA; TAXLABELS a b; END;")
    plan = nexus_commands(spark, str(tmp_path / "a.nex"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # which held the commands of all texts of a batch
