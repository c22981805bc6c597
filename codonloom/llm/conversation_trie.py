"""Operator 13: the prefix trie of conversations, summed by parallel tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.llm.common import cut, split_join, stable, table, with_row_id
from codonloom.llm.conversation_repair import sql_crc32
from codonloom.llm.ordered import hash_in_order, positions
from codonloom.llm.tree_contraction import subtree_totals

#: A conversation is rebuilt with the first turns, fewer than SHARED, of its family's head.
FAMILY, SHARED = 5, 9
#: Conversation numbers in one piece of a node's list.
PIECE = 1 << 16
#: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turns(conversations: DataFrame) -> DataFrame:
    """_c, _pos, _part, _sha (of role and text), _bytes (of the text): every turn with its
    number in its conversation, by turn, null first; ties by role, then by hash. No
    text is shuffled."""
    rows = stable(conversations.select("conv_id", "turn", "role", "text"))
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    light = with_row_id(rows).filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("_c"), "turn", role.alias("role"), F.unhex(F.sha2(F.concat_ws(":", F.length(role), F.concat(role, text)), 256)).alias("_sha"),
        F.octet_length(text).cast("long").alias("_bytes"), "_rid",
    )
    return positions(light, "_c", [F.col("turn").asc_nulls_first(), "role", "_sha", "_rid"]).select("_c", "_pos", "_part", "_sha", "_bytes")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % SHARED


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (_c, _depth, their length) and their turns (_c, _part, _d, _sha, _bytes, _last)."""
    head = F.col("_c") - F.col("_c") % FAMILY
    size = own.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_h": shared_turns(F.col("_c")), "_head": head})
    heads = size.filter(F.col("_c") == F.col("_head")).select("_head", F.col("_n").alias("_given"))
    got = F.least("_h", F.coalesce("_given", F.lit(0)))
    convs = cut(size.join(heads, "_head", "left").select("_c", "_head", "_n", "_h", got.alias("_got"), (got + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("_depth")))
    lent = own.filter((F.col("_c") == head) & (F.col("_pos") < SHARED)).select(F.col("_c").alias("_head"), "_pos", "_sha", "_bytes")
    first = convs.join(lent, "_head").filter(F.col("_pos") <= F.col("_h"))
    first = first.select("_c", F.lit(-1).cast("long").alias("_part"), F.col("_pos").alias("_d"), "_sha", "_bytes", (F.col("_pos") == F.col("_depth")).alias("_last"))
    rest = split_join(own.filter(F.col("_pos") > shared_turns(F.col("_c"))), convs, ["_c"]).withColumn("_d", F.col("_pos") - F.col("_h") + F.col("_got"))
    return convs, first.union(rest.select("_c", "_part", "_d", "_sha", "_bytes", (F.col("_d") == F.col("_depth")).alias("_last")))


def with_prefix(rows: DataFrame) -> DataFrame:
    """rows with _p1, _p2 (128 bits of the turns before a turn) and _h1, _h2 (with it).

    The bits of a prefix are the exclusive or of those of its turns, each hashed with
    its depth: a running sum in the conversation's rows of a part, and the sums of its
    earlier parts.
    """
    one, two = F.xxhash64("_d", "_sha"), F.xxhash64(F.lit(FAMILY), "_sha", "_d")
    rows = rows.withColumns({"_f1": one, "_f2": two})
    within = Window.partitionBy("_c", "_part").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_c", "_part").agg(F.bit_xor("_f1").alias("_s1"), F.bit_xor("_f2").alias("_s2"))
    sums = sums.select("_c", "_part", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("_s1", "_s2")])
    run = rows.withColumns({"_r1": F.bit_xor("_f1").over(within), "_r2": F.bit_xor("_f2").over(within)}).join(sums, ["_c", "_part"])
    run = run.withColumns({"_h1": F.col("_r1").bitwiseXOR(F.col("_s1")), "_h2": F.col("_r2").bitwiseXOR(F.col("_s2"))})
    return run.withColumns({"_p1": F.col("_h1").bitwiseXOR(F.col("_f1")), "_p2": F.col("_h2").bitwiseXOR(F.col("_f2"))})


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, as the contract says.

    A node is a depth and 128 bits of its turns. That all its members have one last
    turn (by SHA-256) and one parent is checked, which by induction makes their turns
    the same; a collision is an error. Subtrees are summed by tree contraction, so the
    rounds grow with the logarithm of the longest conversation. A conversation, a
    node's members or its children may be any share of all rows.

    Nulls: rows with a null conv_id belong to no conversation and are left out; see
    turns() for the others. Empty texts: turns like others. Very long texts: whole, by
    their hash. Ties and repeated rows: each is a turn, see turns(). Empty table: no
    conversation, so no root and an empty result. Other columns: not read.
    """
    convs, rows = rebuilt(turns(conversations))
    rows = cut(with_prefix(rows).select("_c", "_d", "_sha", "_bytes", "_last", "_h1", "_h2", "_p1", "_p2"))

    def same(c: str) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two sequences of turns with equal hashes")).cast("long"))

    inner = rows.groupBy("_d", "_h1", "_h2").agg(
        F.min("_c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), same("_p1").alias("_p1"), same("_p2").alias("_p2"),
        F.when(F.min("_sha") == F.max("_sha"), F.min("_bytes")).otherwise(F.raise_error(F.lit("two turns with equal hashes")).cast("long")).alias("_bytes"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("_c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("_d"), zero.alias("_h1"), zero.alias("_h2"), "conv_id", "n_convs", zero.alias("_p1"), zero.alias("_p2"), zero.alias("_bytes"))
    nodes = cut(inner.union(root).withColumn("id", F.monotonically_increasing_id()))

    up = nodes.select((F.col("_d") + 1).alias("_d"), F.col("_h1").alias("_p1"), F.col("_h2").alias("_p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hung = cut(split_join(nodes, up, ["_d", "_p1", "_p2"], "left"))
    children = hung.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    hung = cut(hung.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    own = hung.select("id", "parent", F.col("_d").alias("level"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("_bytes")).alias("saved_tokens"))

    node = ["_d", "_h1", "_h2"]
    ends = rows.filter("_last").select(*node, "_c").union(convs.filter("_depth = 0").select(zero.alias("_d"), zero.alias("_h1"), zero.alias("_h2"), "_c"))
    pieces = ends.groupBy(*node, F.floor(F.col("_c") / PIECE).alias("_at")).agg(F.array_join(F.array_sort(F.collect_list("_c")), ",").alias("_piece"))
    hashed = hash_in_order(pieces, node, "_at", "_piece", "_d long, _h1 long, _h2 long")
    found = hung.join(subtree_totals(own, ["n_leaves", "saved_tokens"]), "id").join(hashed, node, "left")
    return found.select(
        "conv_id", F.col("_d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % {FAMILY} AS head, {sql_crc32("CAST(c AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM (
  SELECT c.c, 0 AS own, pos, role, text FROM c JOIN t ON t.c = c.head AND pos <= h UNION ALL SELECT c.c, 1, pos, role, text FROM c JOIN t ON t.c = c.c AND pos > h)),
p AS (SELECT c, 0 AS d, '' AS key, 0 AS bytes FROM c UNION ALL
  SELECT c, d, string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY c ORDER BY d), strlen(text) FROM r),
q AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends, min(c) OVER (PARTITION BY d, key) AS node FROM p),
n AS (SELECT d, node, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM q GROUP BY d, node),
up AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN q ON q.c = n.node AND q.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
own AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN k ON k.parent = up.node AND k.d = up.d),
s AS (SELECT q.d, q.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.bytes) AS saved FROM own JOIN q ON q.c = own.node AND q.d <= own.d GROUP BY q.d, q.node)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM own JOIN s USING (d, node)
"""
