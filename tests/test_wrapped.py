"""Sequences over lines and commands with comments, against plain readers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codonloom.functions.comments import pieces
from codonloom.operators import trees as tr
from codonloom.sources import wrapped
from codonloom.sources.formats import nexus_commands, nexus_matrix, read_phylip
from codonloom.sources.wrapped import continued


def plain(lines):
    """(need, n_all, n_rest) of the lines of a file -> (number, whether it begins) of each."""
    out, t, have, open_ = [], 0, 0, False
    for need, n_all, n_rest in lines:
        begins = not open_
        have = n_rest if begins else have + n_all
        out.append((t, begins))
        open_ = have < need
        t += not open_
    return out


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_lines_equal_a_line_by_line_reader(spark, monkeypatch, block):
    monkeypatch.setattr(wrapped, "BLOCK", block)
    rng = random.Random(block)
    files = {}
    for f in range(6):
        need = rng.choice([1, 5, 30])
        files[f] = [(need, n := rng.randrange(0, 9), rng.randrange(0, n + 1)) for _ in range(rng.choice([1, 7, 300]))]
    files[6] = [(10_000, 9, 8)] * 400  # never done
    rows = [(f, 3 * i, *x) for f, v in files.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "file int, pos long, need int, n_all int, n_rest int").repartition(5)
    got = {(r.file, r.pos): (r["_t"], r["_new"]) for r in continued(df, ["file"]).collect()}
    assert got == {(f, 3 * i): x for f, v in files.items() for i, x in enumerate(plain(v))}


def test_a_million_lines(spark):
    """One file of 1e6 lines, sequences of 1 to 5 lines."""
    lines = spark.range(1_000_000).select(F.lit(0).alias("file"), F.col("id").alias("pos"), F.lit(40).alias("need"), (F.xxhash64("id") % 8 + 16).cast("int").alias("n_all"))
    lines = lines.withColumn("n_rest", F.col("n_all") - 6)
    got = continued(lines, ["file"]).select("pos", "_t", "_new", "n_all").toPandas().sort_values("pos")
    want = plain((40, n, n - 6) for n in got["n_all"])
    assert list(zip(got["_t"], got["_new"])) == want


def test_phylip_and_nexus_files(spark, tmp_path):
    rng = random.Random(4)
    seqs = {f"t{i:03}": "".join(rng.choice("ACGT") for _ in range(157)) for i in range(60)}

    def wrap(s):
        out = []
        while s:
            n = rng.randrange(1, 40)
            out.append(s[:n])
            s = s[n:]
        return "\n".join(out)

    (tmp_path / "a.phy").write_text("60 157\n" + "\n".join(f"{k:10}" + wrap(s) for k, s in seqs.items()))
    got = read_phylip(spark, str(tmp_path / "a.phy")).orderBy("taxon_idx").collect()
    assert [(r.name, r.seq) for r in got] == list(seqs.items())
    with pytest.raises(Exception, match="counts"):
        (tmp_path / "b.phy").write_text("59 157\n" + "\n".join(f"{k:10}" + wrap(s) for k, s in seqs.items()))
        read_phylip(spark, str(tmp_path / "b.phy")).collect()
    deep = "[" * 3000 + "x;'" + "]" * 3000
    matrix = "\n".join(f"{k} {wrap(s)}" for k, s in seqs.items())
    (tmp_path / "a.nex").write_text(f"#NEXUS {deep}\nBEGIN DATA; DIMENSIONS NTAX=60 NCHAR=157; FORMAT DATATYPE=DNA; MATRIX\n{matrix}\n; END;")
    rows = nexus_matrix(nexus_commands(spark, str(tmp_path / "a.nex"))).orderBy("taxon_idx").collect()
    assert [(r.name, r.seq) for r in rows] == list(seqs.items())
    flipped = "\n".join(f"c{i} " + "".join(s[i] for s in seqs.values()) for i in range(157))
    (tmp_path / "t.nex").write_text(f"#NEXUS\nBEGIN DATA; DIMENSIONS NTAX=60 NCHAR=157; FORMAT DATATYPE=DNA TRANSPOSE; MATRIX\n{flipped}\n; END;")
    rows = nexus_matrix(nexus_commands(spark, str(tmp_path / "t.nex"))).orderBy("taxon_idx").collect()
    assert [r.name for r in rows] == [f"c{i}" for i in range(157)] and rows[3].transpose
    pages = "\n\n".join("\n".join(f"{k} {s[a:b]}" for k, s in seqs.items()) for a, b in ((0, 60), (60, 61), (61, 157)))
    (tmp_path / "i.nex").write_text(f"#NEXUS\nBEGIN DATA; DIMENSIONS NTAX=60 NCHAR=157; FORMAT DATATYPE=DNA INTERLEAVE; MATRIX\n{pages}\n; END;")
    rows = nexus_matrix(nexus_commands(spark, str(tmp_path / "i.nex"))).orderBy("taxon_idx").collect()
    assert [(r.name, r.seq) for r in rows] == list(seqs.items())


def char_by_char(text, keep):
    found, raw, bare, depth, quoted, kept = [], "", "", 0, False, False
    for i, c in enumerate(text):
        if depth:
            depth += (c == "[") - (c == "]")
            raw += c if kept else ""
        elif c == "[" and not quoted:
            depth, kept = 1, keep == "all" or text[i : i + 2] == "[&"
            raw += c if kept else ""
        elif c == ";" and not quoted:
            found.append((raw, bare))
            raw = bare = ""
        else:
            quoted ^= c == "'"
            raw, bare = raw + c, bare + c
    if depth or quoted:
        return None
    return [*found, (raw, bare)] if raw else found


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab&;'[]"), max_size=25), st.sampled_from(["all", "notes"]))
def test_commands_equal_a_reader_by_characters(text, keep):
    want = char_by_char(text, keep)
    if want is None:
        with pytest.raises(ValueError):
            pieces(text, keep)
    else:
        assert pieces(text, keep) == want


def test_long_names_and_deep_comments_in_trees(spark):
    name = "it''s (a) [b]; " * 70_000  # a megabyte
    texts = [(0, f"('{name}':1,b[{'[' * 10_000}x{']' * 10_000}]:2)r;"), (1, "(a,(b,c)d)r;")]
    got = tr.parse_newick(spark.createDataFrame(texts, "tree_id long, newick string")).orderBy("tree_id", "node_pos").collect()
    assert [(r.name, r.branch_len) for r in got[:3]] == [("r", 0.0), (name.replace("''", "'"), 1.0), ("b", 2.0)]
    assert [r.name for r in got[3:]] == ["r", "a", "d", "b", "c"]
