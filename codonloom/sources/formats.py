"""Alignment and tree files as DataFrames.

Every reader takes a path or glob, or a list of them, that Spark can open and works on
all files at once. FASTA, PHYLIP and Clustal files are read by record or line, by as
many tasks as their size asks for; of the other formats a file is a row that SQL
functions cut into tokens. Results are keyed by ``file``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.functions.genetic import IUPAC
from codonloom.operators.lineage import cut
from codonloom.functions.comments import command_rows
from codonloom.sources.wrapped import continued


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, text: whole files with one kind of line end, for formats whose parts may lie
    anywhere in a file (NEXUS, FIN, trees)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return raw


def records(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """file, block, seq, value: the records of text files. block is where the part of the
    file that a task reads starts, seq grows inside it; together they order a file."""
    raw = spark.read.options(**options).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def ranked(rows: DataFrame, order: list[str], headed: Column | None = None) -> DataFrame:
    """Adds pos, the place in the file from 0. Rows are ranked inside their block and
    moved by the rows of the blocks before, so no task sorts a whole file. Where
    ``headed`` is false for the first row of a file, that row gets -1."""
    first = F.min_by(F.lit(True) if headed is None else headed, F.struct(*order))
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), first.alias("_headed"))
    by_block = Window.partitionBy("file").orderBy("block")  # a row a block
    before = F.sum("_n").over(by_block) - F.col("_n") - (~F.first("_headed").over(by_block)).cast("int")
    at = F.row_number().over(Window.partitionBy("file", "block").orderBy(*order)) - 1
    out = rows.withColumn("_at", at).join(sizes.select("file", "block", before.alias("_before")), ["file", "block"])
    return out.withColumn("pos", F.col("_at") + F.col("_before")).drop("_at", "_before", "block", *order)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pos, line: the lines that aren't blank."""
    rows = records(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    return ranked(rows, ["seq"]).withColumnRenamed("value", "line")


def joined(rows: DataFrame, part: str = "part") -> DataFrame:
    """file, name, seq, first: the parts of each name in order of pos."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", part)))
    out = rows.groupBy("file", "name").agg(F.array_join(F.transform(in_order, lambda x: x[part]), "").alias("seq"), F.min("pos").alias("first"))
    return out


def numbered(sequences: DataFrame) -> DataFrame:
    """Adds taxon_idx, the order of appearance in the file."""
    at = F.row_number().over(Window.partitionBy("file").orderBy("first")) - 1
    return sequences.select("file", at.alias("taxon_idx"), "name", "seq")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, taxon_idx, name, seq: ``>name`` records, sequences over any number of lines.
    Spark reads record by record, so a file of any size is read by many tasks; what
    comes before the first record is left out."""
    raw = records(spark, path, lineSep="\n>")
    piece = F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n>")).alias("k", "piece")
    rows = ranked(raw.select("file", "block", "seq", piece), ["seq", "k"], F.col("piece").startswith(">")).filter("pos >= 0")
    text = F.when(F.col("pos") == 0, F.regexp_replace("piece", "^>", "")).otherwise(F.col("piece"))
    name, seq = F.substring_index(text, "\n", 1), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*+", ""), r"\s++", "")
    return rows.select("file", F.col("pos").alias("taxon_idx"), F.trim(name).alias("name"), seq.alias("seq"))


def alignments(sequences: DataFrame) -> DataFrame:
    """file, n_taxa, n_char, aligned: whether a file's sequences are of one length; others
    belong to an unaligned block."""
    size = F.length("seq")
    return sequences.groupBy("file").agg(F.count(F.lit(1)).alias("n_taxa"), F.max(size).alias("n_char"), (F.min(size) == F.max(size)).alias("aligned"))


def read_phylip(spark: SparkSession, path: str | list[str], interleaved: bool = False, relaxed: bool = False) -> DataFrame:
    """file, taxon_idx, name, seq. Strict names are the first ten characters of a line,
    relaxed ones its first word. Fails where the header's counts don't hold."""
    rows = lines(spark, path)
    counts = r"^\s*(\d+)\s+(\d+)"
    head = rows.filter("pos = 0").select("file", F.regexp_extract("line", counts, 1).cast("int").alias("ntax"), F.regexp_extract("line", counts, 2).cast("int").alias("nchar"))
    body = rows.filter("pos > 0").join(head, "file")
    named = F.regexp_extract("line", r"^\s*(\S+)", 1) if relaxed else F.trim(F.substring("line", 1, 10))
    rest = F.regexp_replace("line", r"^\s*\S+", "") if relaxed else F.expr("substring(line, 11)")
    if interleaved:
        body = body.withColumns({"_t": ((F.col("pos") - 1) % F.col("ntax")).cast("int"), "_new": F.col("pos") <= F.col("ntax")})
    else:
        bare = [F.length(F.regexp_replace(x, r"\s", "")) for x in (F.col("line"), rest)]
        body = continued(body.withColumns({"need": F.col("nchar"), "n_all": bare[0], "n_rest": bare[1]}), ["file"])
    parts = body.select("file", "ntax", "nchar", "pos", "_t", F.when(F.col("_new"), named).alias("label"), F.regexp_replace(F.when(F.col("_new"), rest).otherwise(F.col("line")), r"\s", "").alias("part"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    out = cut(parts.groupBy("file", "ntax", "nchar", F.col("_t").alias("taxon_idx")).agg(F.max("label").alias("name"), in_order.alias("seq")))
    counts = out.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    wrong = (F.length("seq") != F.col("nchar")) | (F.col("_n") != F.col("ntax"))
    checked = F.when(wrong, F.raise_error(F.lit("the header's counts don't hold"))).otherwise(F.col("seq"))
    return out.join(counts, "file").select("file", "taxon_idx", "name", checked.alias("seq"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """file, taxon_idx, name, seq: pages of ``name residues [count]``; the first line and
    the marks below a page are left out."""
    rows = lines(spark, path).filter("pos > 0").select("file", "pos", F.regexp_extract("line", r"^(\S+)\s+([A-Za-z.*?-]+)\s*\d*\s*$", 1).alias("name"), F.regexp_extract("line", r"^(\S+)\s+([A-Za-z.*?-]+)\s*\d*\s*$", 2).alias("part"))
    return numbered(joined(rows.filter("name != ''")))


def read_fin(spark: SparkSession, path: str) -> DataFrame:
    """file, taxon_idx, name, seq: a first line ``label data``, then ``name states`` lines
    up to a line with ``@``; ``/* */`` are comments, ``[..]`` is one of several states."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"(?s)\n\s*@.*$", "")
    rows = files(spark, path).select("file", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = rows.filter("pos = 0").select("file", (F.lower(F.trim("line")) == "label data").alias("_ok"))
    body = rows.filter("pos > 0").filter(F.trim("line") != "").join(head, "file")
    states = F.translate(F.regexp_replace(F.regexp_replace("line", r"^\s*\S+", ""), r"\s", ""), "[]", "{}")
    seq = F.when(F.col("_ok") & (states != ""), states).otherwise(F.raise_error(F.lit("a FIN file needs 'label data' and a sequence for each name")))
    out = body.select("file", F.col("pos").alias("first"), F.replace(F.regexp_extract("line", r"^\s*(\S+)", 1), F.lit("_"), F.lit(" ")).alias("name"), seq.alias("seq"))
    return numbered(out)


def tight(text: Column) -> Column:
    """text without white space outside quotes."""
    return F.regexp_replace(text, r"('[^']*+')|\s++", "$1")


def read_newick(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, tree_id, newick: the trees of a file in order, white space outside quotes
    removed, comments as they are."""
    trees = command_rows(files(spark, path), "all").withColumnRenamed("pos", "tree_id")
    return trees.select("file", "tree_id", F.concat(tight(F.col("raw")), F.lit(";")).alias("newick")).filter("newick != ';'")


# NEXUS -----------------------------------------------------------------------


# Quantifiers are possessive: such groups repeat without recursion, however long a matrix is.
_ITEM = r"((?:[^,']++|'[^']*+')++)"
_WORD = r"'[^']*+(?:''[^']*+)*+'|[^\s,;'()\[\]]++"
_NAME = r"^\s*('[^']*+(?:''[^']*+)*+'|\S++)"
TOKEN = r"('[^']*+(?:''[^']*+)*+'|[=,(){}\[\]]|[^\s=,(){}\[\]']++)"


def unquoted(token: Column) -> Column:
    """A quoted word without its quotes, doubled quotes as one; else underscores as spaces."""
    inside = F.replace(F.regexp_replace(token, "^'|'$", ""), F.lit("''"), F.lit("'"))
    return F.when(token.startswith("'"), inside).otherwise(F.replace(token, F.lit("_"), F.lit(" ")))


def nexus_commands(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block_idx, block, pos, command, body, raw: the commands of every block,
    comments of any depth out; raw keeps the comments that begin with &, which trees need."""
    rows = command_rows(files(spark, path), "notes")
    rows = rows.select("file", "pos", F.regexp_replace("raw", r"(?i)^\s*#NEXUS", "").alias("raw"), F.regexp_replace("bare", r"(?i)^\s*#NEXUS", "").alias("_b"))
    word = F.upper(F.regexp_extract("_b", r"^\s*(\S+)", 1))
    rest = F.trim(F.regexp_replace("raw", r"^\s*\S+", ""))
    rows = rows.select("file", "pos", word.alias("command"), F.trim(F.regexp_replace("_b", r"^\s*\S+", "")).alias("body"), rest.alias("raw")).filter("command != ''")
    by_pos = Window.partitionBy("file").orderBy("pos")
    begin = F.col("command") == "BEGIN"
    return rows.withColumns({"block_idx": F.sum(begin.cast("int")).over(by_pos), "block": F.last(F.when(begin, F.upper(F.trim("body"))), ignorenulls=True).over(by_pos)}).filter(~F.col("command").isin("BEGIN", "END", "ENDBLOCK"))


def nexus_blocks(commands: DataFrame) -> DataFrame:
    """file, block_idx, block, title, n_commands: a report of the blocks, known or not."""
    title = F.max(F.when(F.col("command") == "TITLE", unquoted(F.col("body"))))
    return commands.groupBy("file", "block_idx", "block").agg(title.alias("title"), F.count(F.lit(1)).alias("n_commands"))


def nexus_links(commands: DataFrame) -> DataFrame:
    """file, block_idx, kind, target_idx: the block of a kind that a LINK names by its
    title; without a LINK to taxa, the last TAXA block before. Unknown titles fail."""
    blocks = nexus_blocks(commands)
    kind = F.when(F.col("block") == "DATA", "CHARACTERS").otherwise(F.col("block"))
    titled = blocks.filter("title IS NOT NULL").select("file", kind.alias("kind"), F.lower("title").alias("_title"), F.col("block_idx").alias("target_idx"))
    pair = F.explode(F.regexp_extract_all("body", F.lit(rf"(\w+\s*=\s*(?:{_WORD}))"), 1)).alias("p")
    asked = commands.filter("command = 'LINK'").select("file", "block_idx", pair).select(
        "file", "block_idx", F.upper(F.regexp_extract("p", r"^(\w+)", 1)).alias("kind"), F.lower(unquoted(F.regexp_replace("p", r"^\w+\s*=\s*", ""))).alias("_title")
    )
    named = asked.join(titled, ["file", "kind", "_title"], "left").select("file", "block_idx", "kind", F.coalesce("target_idx", F.raise_error(F.lit("a LINK names no block's title")).cast("long")).alias("target_idx"))
    taxa = F.last(F.when(F.col("block") == "TAXA", F.col("block_idx")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block_idx"))
    before = blocks.withColumn("target_idx", taxa).filter("block != 'TAXA' AND target_idx IS NOT NULL").select("file", "block_idx", F.lit("TAXA").alias("kind"), "target_idx")
    return named.unionByName(before.join(named.select("file", "block_idx", "kind"), ["file", "block_idx", "kind"], "left_anti"))


def option(body: Column, name: str, default: str) -> Column:
    """The value of ``name=value`` in a FORMAT or DIMENSIONS command."""
    found = F.regexp_extract(body, rf"(?i)\b{name}\s*=\s*(\"[^\"]*\"|\S+)", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.regexp_replace(found, '"', ""))


def nexus_taxa(commands: DataFrame) -> DataFrame:
    """file, block_idx, taxon_idx, name."""
    rows = commands.filter("block = 'TAXA' AND command = 'TAXLABELS'")
    return rows.select("file", "block_idx", F.posexplode(F.regexp_extract_all("body", F.lit(TOKEN), 1)).alias("taxon_idx", "t")).select("file", "block_idx", "taxon_idx", unquoted(F.col("t")).alias("name"))


#: The states of each datatype. (fixed values)
SYMBOLS = {"dna": "ACGT", "nucleotide": "ACGT", "rna": "ACGU", "protein": "ACDEFGHIKLMNPQRSTVWY*", "standard": "01"}
#: Ambiguous amino acids as the states they stand for. (fixed values)
AMINO_EQUATES = {"B": "DN", "Z": "EQ"}


def default_equates(datatype: str) -> dict[str, str]:
    """Symbols of a datatype that stand for other states."""
    if datatype == "protein":
        return AMINO_EQUATES
    if datatype not in ("dna", "rna", "nucleotide"):
        return {}
    t = "U" if datatype == "rna" else "T"
    found = {k: v.replace("T", t) for k, v in IUPAC.items() if k not in "ACGTU"}
    return found | {"T" if t == "U" else "U": t}


def nexus_formats(commands: DataFrame) -> DataFrame:
    """file, block_idx and the FORMAT of each character block: datatype, missing, gap,
    matchchar, symbols, equates (symbol to states, the datatype's own first), transpose,
    interleave, tokens (words as cells), respectcase, nchar."""
    blocks = commands.filter(F.col("block").isin("CHARACTERS", "DATA"))
    has = lambda word: F.coalesce(F.max(F.when(F.col("command") == "FORMAT", F.col("body").rlike(rf"(?i)(?<![\w=\"]){word}\b(?!\s*=\s*NO\b)"))), F.lit(False))
    value = lambda name, default: F.coalesce(F.max(F.when(F.col("command") == "FORMAT", option(F.col("body"), name, default))), F.lit(default))
    nchar = F.max(F.when(F.col("command") == "DIMENSIONS", option(F.col("body"), "NCHAR", "0").cast("int")))
    form = blocks.groupBy("file", "block_idx").agg(
        F.lower(value("DATATYPE", "standard")).alias("datatype"), value("MISSING", "?").alias("missing"), value("GAP", "-").alias("gap"), value("MATCHCHAR", "").alias("matchchar"),
        F.regexp_replace(value("SYMBOLS", ""), r"\s", "").alias("_symbols"), value("EQUATE", "").alias("_equate"), has("TRANSPOSE").alias("transpose"), has("INTERLEAVE").alias("interleave"),
        has("TOKENS").alias("tokens"), has("RESPECTCASE").alias("respectcase"), F.coalesce(nchar, F.lit(0)).alias("nchar"),
    )
    known = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    given = F.coalesce(F.element_at(known, F.col("datatype")), F.lit(""))
    symbols = F.when(F.col("datatype") == "standard", F.when(F.col("_symbols") != "", F.col("_symbols")).otherwise(given)).otherwise(F.concat(given, "_symbols"))
    own = F.create_map().cast("map<string,string>")
    for d in SYMBOLS:
        if default_equates(d):
            own = F.when(F.col("datatype") == d, F.create_map(*[F.lit(x) for kv in default_equates(d).items() for x in kv])).otherwise(own)
    pairs = F.regexp_extract_all("_equate", F.lit(r"(\S\s*=\s*(?:\([^)]*\)|\{[^}]*\}|\S))"), 1)
    entry = F.transform(pairs, lambda x: F.struct(F.substring(x, 1, 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"^\S\s*=", ""), r"[\s(){}]", "").alias("value")))
    user = F.map_from_entries(entry)
    equates = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(user), k)), user)
    words = F.col("tokens") | (F.col("datatype") == "continuous")
    return form.select("file", "block_idx", "datatype", "missing", "gap", "matchchar", symbols.alias("symbols"), equates.alias("equates"), "transpose", "interleave", words.alias("tokens"), "respectcase", "nchar")


_CELL = r"(\{[^}]*+\}|\([^)]*+\)|\S)"
_TOKEN_CELL = r"(\{[^}]*+\}|\([^)]*+\)|[^\s(){}]++)"


def cell_list(text: Column, tokens: Column) -> Column:
    """The cells of a text: characters, or words if the block has tokens."""
    return F.when(tokens, F.regexp_extract_all(text, F.lit(_TOKEN_CELL), 1)).otherwise(F.regexp_extract_all(text, F.lit(_CELL), 1))


def nexus_matrix(commands: DataFrame) -> DataFrame:
    """file, block_idx, taxon_idx, name, seq and the block's format (``nexus_formats``).

    A sequence goes on over lines until it has NCHAR cells; interleaved pages join by
    name, a match character takes the first taxon's state, a transposed matrix swaps
    names and positions. Cells of token and continuous matrices are a blank apart.
    """
    blocks = commands.filter(F.col("block").isin("CHARACTERS", "DATA"))
    form = nexus_formats(commands)
    rows = blocks.filter("command = 'MATRIX'").select("file", "block_idx", F.posexplode(F.split("body", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    rows = rows.withColumn("pos", F.col("pos").cast("long")).join(form, ["file", "block_idx"])
    rest = F.regexp_replace("line", _NAME, "")
    alone = F.col("transpose") | F.col("interleave")
    sizes = {"need": F.when(alone, 0).otherwise(F.col("nchar")), "n_all": F.size(cell_list(F.col("line"), F.col("tokens"))), "n_rest": F.size(cell_list(rest, F.col("tokens")))}
    placed = continued(rows.withColumns(sizes), ["file", "block_idx"])
    # Pages of an interleaved matrix repeat their names, which join them.
    cut = placed.withColumns({"name": F.when(F.col("_new"), unquoted(F.regexp_extract("line", _NAME, 1))), "part": cell_list(F.when(F.col("_new"), rest).otherwise(F.col("line")), F.col("tokens"))})
    key = F.when(F.col("interleave"), F.col("name")).otherwise(F.col("_t").cast("string"))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]))
    whole = cut.groupBy("file", "block_idx", key.alias("_key")).agg(F.max("name").alias("name"), in_order.alias("cells"), F.min("_t").alias("taxon_idx")).drop("_key")
    out = whole.join(form, ["file", "block_idx"])
    first = out.filter("taxon_idx = 0 AND matchchar != ''").select("file", "block_idx", F.col("cells").alias("_first"))
    matched = F.zip_with("cells", "_first", lambda a, b: F.when(a == F.col("matchchar"), b).otherwise(a))
    cells = F.when(F.col("_first").isNotNull(), matched).otherwise(F.col("cells"))
    seq = F.when(F.col("tokens"), F.array_join(cells, " ")).otherwise(F.array_join(cells, ""))
    return out.join(first, ["file", "block_idx"], "left").select("file", "block_idx", "taxon_idx", "name", seq.alias("seq"), *form.columns[2:])


def nexus_cells(matrix: DataFrame) -> DataFrame:
    """file, block_idx, taxon_idx, char_idx, symbol, kind, states: one cell a row.
    ``{..}`` is one of several states (uncertain), ``(..)`` all of them (polymorphic).
    Equates are followed in states, and an equate of several states is uncertain; a
    symbol that the format doesn't have is of kind unknown."""
    rows = matrix.select("*", F.posexplode(cell_list(F.col("seq"), F.col("tokens"))).alias("_p", "symbol"))
    rows = rows.withColumn("_bare", F.regexp_replace("symbol", r"^[{(]\s*|\s*[})]$", ""))
    parts = F.when(F.col("tokens"), F.split("_bare", r"[\s,]+")).otherwise(F.split(F.regexp_replace("_bare", r"[\s,]", ""), ""))

    def states(x: Column) -> Column:
        """A symbol's states, as written if the format has it so, else in capitals."""
        other = F.when(F.col("respectcase"), x).otherwise(F.upper(x))
        own = F.when(F.contains(F.col("symbols"), x), x).otherwise(other)
        meant = F.coalesce(F.element_at("equates", x), F.element_at("equates", own))
        return F.when(F.col("tokens"), F.array(x)).when(meant.isNotNull(), F.split(meant, "")).otherwise(F.array(own))

    rows = rows.withColumn("states", F.array_distinct(F.flatten(F.transform(parts, states))))
    known = F.col("tokens") | F.forall("states", lambda x: F.contains(F.col("symbols"), x))
    kind = (
        F.when(F.col("symbol") == F.col("missing"), "missing").when(F.col("symbol") == F.col("gap"), "gap")
        .when(~known, "unknown").when(F.col("symbol").startswith("("), "polymorphic")
        .when(F.col("symbol").startswith("{") | (F.size("states") > 1), "uncertain").otherwise("state")
    )
    taxon, char = (F.when(F.col("transpose"), F.col(a)).otherwise(F.col(b)) for a, b in (("_p", "taxon_idx"), ("taxon_idx", "_p")))
    bare = F.when(F.col("tokens"), F.col("_bare")).otherwise(F.regexp_replace("_bare", r"\s", ""))
    return rows.select("file", "block_idx", taxon.alias("taxon_idx"), char.alias("char_idx"), bare.alias("symbol"), kind.alias("kind"), F.when(kind.isin("missing", "gap"), F.array().cast("array<string>")).otherwise(F.col("states")).alias("states"))


def nexus_char_labels(commands: DataFrame) -> DataFrame:
    """file, block_idx, char_idx, label: from CHARLABELS, or CHARSTATELABELS by number."""
    blocks = commands.filter(F.col("block").isin("CHARACTERS", "DATA"))
    plain = blocks.filter("command = 'CHARLABELS'").select("file", "block_idx", F.posexplode(F.regexp_extract_all("body", F.lit(TOKEN), 1)).alias("char_idx", "t"))
    item = blocks.filter("command = 'CHARSTATELABELS'").select("file", "block_idx", F.explode(F.regexp_extract_all("body", F.lit(_ITEM), 1)).alias("i"))
    by_number = item.select("file", "block_idx", (F.regexp_extract("i", r"^\s*(\d+)", 1).cast("int") - 1).alias("char_idx"), F.regexp_extract("i", rf"^\s*\d+\s+({_WORD})", 1).alias("t"))
    return plain.unionByName(by_number.filter("t != '' AND t != '/'")).select("file", "block_idx", "char_idx", unquoted(F.col("t")).alias("label"))


def nexus_state_labels(commands: DataFrame) -> DataFrame:
    """file, block_idx, char_idx, state_idx, label: from STATELABELS or CHARSTATELABELS."""
    blocks = commands.filter(F.col("block").isin("CHARACTERS", "DATA") & F.col("command").isin("STATELABELS", "CHARSTATELABELS"))
    item = blocks.select("file", "block_idx", "command", F.explode(F.regexp_extract_all("body", F.lit(_ITEM), 1)).alias("i"))
    after = F.when(F.col("command") == "STATELABELS", F.regexp_replace("i", r"^\s*\d+", "")).when(F.col("i").contains("/"), F.regexp_replace("i", r"^[^/]*/", ""))
    number = F.regexp_extract("i", r"^\s*(\d+)", 1).cast("int") - 1
    return item.select("file", "block_idx", number.alias("char_idx"), F.posexplode(F.regexp_extract_all(after, F.lit(TOKEN), 1)).alias("state_idx", "t")).select("file", "block_idx", "char_idx", "state_idx", unquoted(F.col("t")).alias("label"))


def nexus_eliminated(commands: DataFrame) -> DataFrame:
    """file, block_idx, name, definition: the set of characters that ELIMINATE leaves out."""
    rows = commands.filter(F.col("block").isin("CHARACTERS", "DATA") & (F.col("command") == "ELIMINATE"))
    return rows.select("file", "block_idx", F.lit("eliminated").alias("name"), F.col("body").alias("definition"))


def nexus_trees(commands: DataFrame) -> DataFrame:
    """file, block_idx, tree_id, tree_name, rooted, newick, with the block's TRANSLATE
    applied. rooted is what [&R] or [&U] says, false for UTREE, else null; comments
    inside the tree that begin with & stay in newick."""
    blocks = commands.filter("block = 'TREES'")
    pairs = blocks.filter("command = 'TRANSLATE'").select("file", "block_idx", F.explode(F.regexp_extract_all("body", F.lit(_ITEM), 1)).alias("p")).select(
        "file", "block_idx", F.regexp_extract("p", _NAME, 1).alias("key"), F.regexp_extract("p", rf"^\s*(?:{_WORD})\s+({_WORD})", 1).alias("taxon")
    )
    maps = pairs.groupBy("file", "block_idx").agg(F.map_from_entries(F.collect_list(F.struct("key", "taxon"))).alias("_map"))
    tree = F.regexp_replace("raw", r"^[^=]*=", "")
    lead = F.regexp_extract(tree, r"^((?:\s*\[[^\]]*\])*+)", 1)
    mark = F.upper(F.regexp_extract(lead, r"\[&([RrUu])\]", 1))
    rooted = F.when(mark != "", mark == "R").when(F.col("command") == "UTREE", False)
    trees = blocks.filter(F.col("command").isin("TREE", "UTREE")).select(
        "file", "block_idx", "pos", unquoted(F.trim(F.regexp_extract("raw", r"^\*?\s*([^=]+)=", 1))).alias("tree_name"), rooted.alias("rooted"),
        tight(F.regexp_replace(tree, r"^(?:\s*\[[^\]]*\])*+", "")).alias("t"),
    ).join(maps, ["file", "block_idx"], "left")
    tokens = F.regexp_extract_all("t", F.lit(r"('[^']*+(?:''[^']*+)*+'|\[[^\]]*+\]|[(),]|:[^(),:\[]*+|[^(),:\[']++)"), 1)
    renamed = F.array_join(F.transform(tokens, lambda x: F.coalesce(F.element_at("_map", x), x)), "")
    at = F.row_number().over(Window.partitionBy("file", "block_idx").orderBy("pos")) - 1
    return trees.select("file", "block_idx", at.alias("tree_id"), "tree_name", "rooted", F.concat(F.when(F.col("_map").isNull(), F.col("t")).otherwise(renamed), F.lit(";")).alias("newick"))


def newick_notes(trees: DataFrame) -> DataFrame:
    """(tree_id, newick) -> tree_id, label, key, value: the comments behind nodes, as
    ``[&key=value,..]`` or ``[&&NHX:key=value:..]``. label is the node's name."""
    found = F.regexp_extract_all("newick", F.lit(r"((?:'[^']*+(?:''[^']*+)*+'|[^\s(),:;\['\]]++)?(?::[^(),:;\['\]]*+)?\[&[^\]]*+\])"), 1)
    label = F.regexp_extract("n", r"^('[^']*+(?:''[^']*+)*+'|[^:\[]*+)", 1)
    label = F.when(label.startswith("'"), unquoted(label)).otherwise(label)
    rows = trees.select("tree_id", F.explode(found).alias("n")).select("tree_id", label.alias("label"), F.regexp_extract("n", r"\[&([^\]]*)\]", 1).alias("c"))
    items = F.when(F.col("c").startswith("&NHX"), F.split(F.regexp_replace("c", "^&NHX:?", ""), ":")).otherwise(F.split("c", ","))
    pair = rows.select("tree_id", "label", F.explode(items).alias("p")).filter(F.contains(F.col("p"), F.lit("=")))
    return pair.select("tree_id", "label", F.substring_index("p", "=", 1).alias("key"), F.regexp_replace("p", "^[^=]*=", "").alias("value"))


def nexus_sets(commands: DataFrame) -> DataFrame:
    """file, kind, name, definition: CHARSET, TAXSET, TREESET, EXSET and the partitions."""
    rows = commands.filter(F.col("command").isin("CHARSET", "TAXSET", "TREESET", "EXSET", "CHARPARTITION", "TAXPARTITION", "TREEPARTITION", "WTSET", "TYPESET", "CODESET", "CODONPOSSET"))
    return rows.select("file", F.lower("command").alias("kind"), unquoted(F.trim(F.regexp_extract("body", r"^\*?\s*([^=(]+?)\s*(?:\([^)]*\))?\s*=", 1))).alias("name"), F.trim(F.regexp_replace("body", r"^[^=]*=", "")).alias("definition"))


def nexus_usertypes(commands: DataFrame) -> DataFrame:
    """file, name, form, definition: the USERTYPEs of ASSUMPTIONS blocks; form is cstree
    (definition: a tree of states) or stepmatrix (size, states and rows of steps)."""
    rows = commands.filter("command = 'USERTYPE'")
    head, form = F.regexp_extract("body", r"^\*?\s*([^=]*)=", 1), F.lower(F.regexp_extract("body", r"^[^=(]*\(([^)]*)\)\s*[^=]*=", 1))
    name = F.trim(F.regexp_replace(F.regexp_replace(head, r"\([^)]*\)", ""), r"(?i)\s(STEPMATRIX|REALMATRIX|CSTREE)\b.*$", ""))
    tree = form.contains("cstree") | F.upper(head).rlike(r"\sCSTREE\s*$")
    return rows.select("file", unquoted(name).alias("name"), F.when(tree, "cstree").otherwise("stepmatrix").alias("form"), F.trim(F.regexp_replace("body", r"^[^=]*=", "")).alias("definition"))


def nexus_options(commands: DataFrame) -> DataFrame:
    """file, block_idx, deftype, polytcount, gapmode: the OPTIONS of ASSUMPTIONS blocks."""
    rows = commands.filter("block = 'ASSUMPTIONS' AND command = 'OPTIONS'")
    read = lambda k, d: F.lower(option(F.col("body"), k, d)).alias(k.lower())
    return rows.select("file", "block_idx", read("DEFTYPE", "unord"), read("POLYTCOUNT", "minsteps"), read("GAPMODE", "missing"))


def nexus_distances(commands: DataFrame) -> DataFrame:
    """file, block_idx, row, col, name, d: the cells of a lower, upper or full triangle,
    null if missing; name is the row's. Interleaved pages join by name; without labels
    (NOLABELS) every line is a row."""
    blocks = commands.filter("block = 'DISTANCES'")
    bare, unnamed = F.col("body").rlike(r"(?i)\bNODIAGONAL\b"), F.col("body").rlike(r"(?i)\bNOLABELS\b|\bLABELS\s*=\s*NO\b")
    form = blocks.filter("command = 'FORMAT'").select("file", "block_idx", F.lower(option(F.col("body"), "TRIANGLE", "lower")).alias("triangle"), bare.alias("bare"), unnamed.alias("unnamed"), option(F.col("body"), "MISSING", "?").alias("missing"))
    rows = blocks.filter("command = 'MATRIX'").select("file", "block_idx", F.posexplode(F.split("body", "\n")).alias("pos", "line")).filter(F.trim("line") != "").join(form, ["file", "block_idx"], "left")
    rows = rows.fillna({"triangle": "lower", "bare": False, "unnamed": False, "missing": "?"})
    name = F.when(~F.col("unnamed"), unquoted(F.regexp_extract("line", _NAME, 1)))
    parts = rows.select("file", "block_idx", "pos", "triangle", "bare", "missing", name.alias("name"), F.coalesce(name, F.col("pos").cast("string")).alias("_key"),
                        F.regexp_extract_all(F.when(F.col("unnamed"), F.col("line")).otherwise(F.regexp_replace("line", _NAME, "")), F.lit(r"(\S++)"), 1).alias("part"))
    whole = parts.groupBy("file", "block_idx", "triangle", "bare", "missing", "_key").agg(
        F.first("name").alias("name"), F.min("pos").alias("_f"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])).alias("cells")
    )
    whole = whole.withColumn("row", F.row_number().over(Window.partitionBy("file", "block_idx").orderBy("_f")) - 1)
    cells = whole.select("file", "block_idx", "row", "name", "triangle", "bare", "missing", F.posexplode("cells").alias("_c", "v"))
    shift = F.when(F.col("triangle") == "upper", F.col("row") + F.col("bare").cast("int")).otherwise(0)
    return cells.select("file", "block_idx", "row", (F.col("_c") + shift).alias("col"), "name", F.when(F.col("v") != F.col("missing"), F.expr("try_cast(v AS DOUBLE)")).alias("d"))


def nexus_unaligned(commands: DataFrame) -> DataFrame:
    """file, block_idx, name, seq: ragged sequences, ended by commas."""
    rows = commands.filter("block = 'UNALIGNED' AND command = 'MATRIX'").select("file", "block_idx", F.explode(F.regexp_extract_all("body", F.lit(_ITEM), 1)).alias("r")).filter(F.trim(F.regexp_replace("r", r"\s", " ")) != "")
    return rows.select("file", "block_idx", unquoted(F.regexp_extract("r", _NAME, 1)).alias("name"), F.regexp_replace(F.regexp_replace("r", _NAME, ""), r"\s++", "").alias("seq"))


def nexus_associations(commands: DataFrame) -> DataFrame:
    """file, a, b: every pair of taxa that a TAXAASSOCIATION block links."""
    rows = commands.filter("block = 'TAXAASSOCIATION' AND command = 'ASSOCIATES'").select("file", F.explode(F.regexp_extract_all("body", F.lit(_ITEM), 1)).alias("r")).filter(F.col("r").contains("/"))
    half = r"((?:[^/']++|'[^']*+')*+)"
    side = [F.regexp_extract_all(F.regexp_extract("r", f"^{half}/{half}", k), F.lit(TOKEN), 1) for k in (1, 2)]
    return rows.select("file", F.explode(side[0]).alias("_a"), side[1].alias("_bs")).select("file", "_a", F.explode("_bs").alias("_b")).select("file", unquoted(F.col("_a")).alias("a"), unquoted(F.col("_b")).alias("b"))


def nexus_codons(spark: SparkSession, path: str) -> DataFrame:
    """file, taxon_idx, name, seq of the one character matrix of each file, for codon
    models. More than one TAXA or character block, an UNALIGNED block, or a length
    that three doesn't divide fail."""
    commands = nexus_commands(spark, path)
    blocks = commands.select("file", "block_idx", "block").distinct().groupBy("file").agg(
        F.count_if(F.col("block") == "TAXA").alias("t"), F.count_if(F.col("block").isin("CHARACTERS", "DATA")).alias("c"), F.count_if(F.col("block") == "UNALIGNED").alias("u")
    )
    m = nexus_matrix(commands).join(blocks, "file")
    bad = (F.col("t") > 1) | (F.col("c") > 1) | (F.col("u") > 0)
    checked = F.when(bad, F.raise_error(F.lit("one TAXA and one character block are needed"))).when(F.length("seq") % 3 != 0, F.raise_error(F.lit("the length is no multiple of 3"))).otherwise(F.upper("seq"))
    return m.select("file", "taxon_idx", "name", checked.alias("seq"))


def fasta_to_nexus(spark: SparkSession, path: str) -> DataFrame:
    """file, value: a NEXUS text for each aligned FASTA file."""
    from codonloom.sources.sinks import nexus_text

    return nexus_text(read_fasta(spark, path))


def read_trace_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated traces as (file, iteration, param, value)."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    keys = [c for c in wide.columns if c in ("Iteration", "chain", "replicate")]
    params = [c for c in wide.columns if c not in keys]
    long = wide.unpivot([F.col(k).cast("long").alias(k.lower()) for k in keys], [F.col(f"`{p}`").cast("double").alias(p) for p in params], "param", "value")
    return long.filter(F.col("value").isNotNull())


READERS = {
    "fasta": read_fasta,
    "phylip": read_phylip,
    "phylip-relaxed": lambda s, p: read_phylip(s, p, relaxed=True),
    "phylip-interleaved": lambda s, p: read_phylip(s, p, interleaved=True),
    "phylip-interleaved-relaxed": lambda s, p: read_phylip(s, p, interleaved=True, relaxed=True),
    "aln": read_clustal,
    "fin": read_fin,
    "newick": read_newick,
    "phyliptree": read_newick,
    "relaxedphyliptree": read_newick,
    "nexus": nexus_commands,
    "nexus-codons": nexus_codons,
}
#: What names of formats call the datatypes.
DATATYPES = {"dna": "dna", "rna": "rna", "aa": "protein", "discrete": "standard"}


def read(spark: SparkSession, format: str, path: str | list[str]) -> DataFrame:
    """The files of a format by name. A name may begin with a datatype, which becomes a
    column: dnafasta, aaaln, rnafin, discretephylip, dnarelaxedphylipinterleaved."""
    if format in READERS:
        return READERS[format](spark, path)
    for prefix, datatype in DATATYPES.items():
        kind = format.removeprefix(prefix)
        if format.startswith(prefix) and kind in ("fasta", "aln", "fin") and prefix != "discrete":
            return READERS[kind](spark, path).withColumn("datatype", F.lit(datatype))
        if format.startswith(prefix) and kind in ("phylip", "phylipinterleaved", "relaxedphylip", "relaxedphylipinterleaved"):
            return read_phylip(spark, path, "interleaved" in kind, "relaxed" in kind).withColumn("datatype", F.lit(datatype))
    raise ValueError(f"no such format: {format}")


def read_listed(spark: SparkSession, format: str, path: str) -> DataFrame:
    """The files that the lines of a text file name."""
    return read(spark, format, [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()])
