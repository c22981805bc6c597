"""Queries on trees, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codonloom.operators import trees as tr
from codonloom.operators.lineage import cut, new_path, small
from codonloom.operators.step_types import unsupported_nodes
from codonloom.sources.adapters import tree_nodes, with_sql
from codonloom.sources.formats import newick_notes
from codonloom.streaming import tree_stream

TREES = 20


def one_tree(spark, d):
    return tree_nodes(spark, d).select(F.lit(0).alias("tree_id"), "node_idx", "parent_idx", "name", "is_tip", "branch_len")


def forest(spark, d):
    """20 trees: in tree t, every seventh tip hangs under the next region."""
    t = tree_nodes(spark, d)
    ids = t.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree_id"), *t.columns)
    moved = F.col("is_tip") & (F.col("node_idx") % 7 == F.col("tree_id") % 7)
    parent = F.when(moved, 25 + (F.col("parent_idx") - 25 + 1) % 5).otherwise(F.col("parent_idx"))
    return ids.withColumns({"parent_idx": parent, "branch_len": F.col("branch_len") + F.col("tree_id") * 0.01})


def tree_traversal(spark, d):
    return tr.traversal(forest(spark, d)).select("tree_id", "node_idx", "depth", "pre_order", "post_order")


def tree_closure(spark, d):
    return tr.closure(forest(spark, d)).withColumn("dist", F.round("dist", 6))


def patristic_distance(spark, d):
    return tr.patristic(forest(spark, d)).withColumn("dist", F.round("dist", 6))


def distance_cells(rows):
    """The rows of matrices as text, - for the tip itself."""
    cell = F.transform("distances", lambda x: F.when(x.isNull(), "-").otherwise(F.format_string("%.6f", x)))
    return rows.select("tree_id", "tip", F.array_join(cell, " ").alias("distances"))


def patristic_matrix(spark, d):
    return distance_cells(tr.patristic_matrix(forest(spark, d)))


def patristic_to_mrca(spark, d):
    return distance_cells(tr.patristic_matrix(forest(spark, d), to_mrca=True))


def order_trees(spark, d):
    """A tree for each order status: orders under customers, these one under another in a
    chain by number, so it is as deep as there are customers."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.ascii("o_orderstatus").alias("tree_id"), F.col("o_orderkey").cast("int").alias("k"), F.col("o_custkey").cast("int").alias("c"), (F.floor(F.col("o_totalprice") / 10.0) / 100.0).alias("branch_len"))
    last = o.agg(F.max("k")).first()[0] + 1
    tips = o.select("tree_id", F.col("k").alias("node_idx"), (F.col("c") + last).alias("parent_idx"), F.lit(True).alias("is_tip"), "branch_len")
    customers = o.select("tree_id", (F.col("c") + last).alias("node_idx")).distinct()
    chain = F.lag("node_idx").over(Window.partitionBy("tree_id").orderBy("node_idx"))
    return tips.unionByName(customers.select("tree_id", "node_idx", chain.alias("parent_idx"), F.lit(False).alias("is_tip"), F.lit(1.0).alias("branch_len")))


def deep_trees(spark, d):
    """Place, depth, length from the root and tips below of every node of deep trees."""
    trees = order_trees(spark, d)
    root = small(cut(trees.filter("parent_idx IS NULL").select("tree_id", F.col("branch_len").alias("_root"))))
    return tr.placed_nodes(trees, prints=False).join(root, "tree_id").select("tree_id", "node_idx", "depth", "pre_order", "post_order", "size", "n_tips", F.round(F.col("dist") - F.col("_root"), 2).alias("dist"))


def nodes_without_support(spark, d):
    """Customers that no name, and no third customer's support, tells of in the trees of orders."""
    t = order_trees(spark, d).withColumn("name", F.when(F.col("is_tip"), F.concat(F.lit("o"), F.col("node_idx").cast("string"))))
    last = t.filter("is_tip").agg(F.max("node_idx")).first()[0] + 1
    held = t.filter(~F.col("is_tip") & ((F.col("node_idx") - last) % 3 == 0)).select("tree_id", "node_idx")
    return unsupported_nodes(t, held)


def outdegrees_rerooted(spark, d):
    """After the first taxon became the root."""
    return tr.out_degrees(tr.reroot(forest(spark, d), 0))


def tree_dump(spark, d):
    return tr.indented(forest(spark, d))


def nhx_notes(spark, d):
    """Numbers and parents of nodes as NHX comments, written and read."""
    texts = tr.newick(forest(spark, d), nhx=["node_idx", "parent_idx"])
    return newick_notes(texts).select("tree_id", F.col("label").alias("name"), "key", F.col("value").cast("int").alias("value"))


def streamed_splits(spark, d):
    """The trees' splits counted as their files arrive, four batches."""
    at = [new_path(spark) for _ in range(3)]
    trees = forest(spark, d).select(F.col("tree_id").cast("long").alias("tree_id"), "node_idx", "parent_idx", "name", "is_tip", "branch_len")
    trees.repartition(4, "tree_id").write.parquet(at[0])
    tree_stream.watch_splits(spark, at[0], at[1], at[2], 1).awaitTermination()
    return tree_stream.split_totals(spark, at[1]).withColumns(joined("split")).withColumn("mean_len", F.round("mean_len", 6))


def tree_labels(spark, d):
    return tr.labels(forest(spark, d))


def taxon_leaves(spark, d):
    """Nations' leaves in the forest; one taxon more has none."""
    taxa = tree_nodes(spark, d).filter("is_tip").select("name", F.col("node_idx").alias("taxon_idx"))
    more = taxa.agg(F.lit("nowhere").alias("name"), (F.max("taxon_idx") + 1).alias("taxon_idx"))
    return tr.leaves_of_taxa(forest(spark, d), taxa.union(more))


def outdegree_histogram(spark, d):
    return tr.out_degrees(forest(spark, d))


def single_child_nodes(spark, d):
    t = one_tree(spark, d)
    chain = t.filter("parent_idx = 25").select("tree_id", (F.col("node_idx") + 100).alias("node_idx"), F.col("node_idx").alias("parent_idx"), F.lit(None).cast("string").alias("name"), "is_tip", "branch_len")
    return tr.single_child_nodes(t.union(chain))


def joined(*columns):
    """Arrays of tips as text."""
    return {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns}


def tree_splits(spark, d):
    return tr.splits(forest(spark, d)).withColumns(joined("split")).withColumns({c: F.round(c, 6) for c in ("branch_len", "height")})


def split_frequencies(spark, d):
    return tr.split_frequencies(forest(spark, d), 2).withColumns(joined("split")).withColumns({c: F.round(c, 6) for c in ("sum_len", "sum_len_sq", "mean_len", "mean_height", "frequency")})


def unsupported_splits(spark, d):
    """In every seventh tree the tips hang alike, so the forest and the first tree under another root."""
    t = forest(spark, d)
    odd = t.filter("tree_id = 0").withColumns({"tree_id": F.lit(TREES), "parent_idx": F.when(F.col("node_idx") == 4, 26).otherwise(F.col("parent_idx"))})
    return tr.unsupported_splits(t.unionByName(odd), TREES).withColumns(joined("split"))


def compared_nodes(spark, d):
    return tr.compare_nodes(forest(spark, d), 0, 1).withColumns(joined("only_a", "only_b"))


def tip_masks(spark, d):
    return tr.tips_below(forest(spark, d)).withColumns(joined("tips")).select("tree_id", "node_idx", "tips", "n_tips")


def subtree_of_tips(spark, d):
    return tr.subtree(forest(spark, d), [3, 8])


def rerooted(spark, d):
    return tr.reroot(forest(spark, d), 7).select("tree_id", "node_idx", "parent_idx", F.round("branch_len", 6).alias("branch_len"))


def tree_inspection(spark, d):
    t = forest(spark, d)
    return t.groupBy("tree_id").agg(
        F.count_if("is_tip").alias("n_tips"), F.count_if(~F.col("is_tip")).alias("n_inner"), F.round(F.sum("branch_len"), 6).alias("tree_length"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_tip"), F.col("name")))), ",").alias("tip_names"),
    )


def newick_text(spark, d):
    return tr.newick(one_tree(spark, d))


def newick_round_trip(spark, d):
    """Written, parsed and bound to the taxa again: parent and length of every node."""
    taxa = tree_nodes(spark, d).filter("is_tip").select(F.col("node_idx").alias("taxon_idx"), "name")
    again = tr.bind_taxa(cut(tr.parse_newick(cut(tr.newick(forest(spark, d))))), taxa)
    return again.select("tree_id", "node_idx", "name", F.round("branch_len", 6).alias("branch_len"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_traversal, tree_closure, patristic_distance, patristic_matrix, patristic_to_mrca, deep_trees, nodes_without_support, outdegrees_rerooted, tree_dump, nhx_notes, streamed_splits, tree_labels, taxon_leaves, outdegree_histogram, single_child_nodes, tree_splits, split_frequencies,
        unsupported_splits, compared_nodes, tip_masks, subtree_of_tips, rerooted, tree_inspection, newick_text, newick_round_trip,
    )
}

_FOREST = with_sql("tree_nodes") + """,
forest AS (SELECT CAST(t.range AS INT) tree_id, node_idx,
    CAST(CASE WHEN is_tip AND node_idx % 7 = t.range % 7 THEN 25 + (parent_idx - 25 + 1) % 5 ELSE parent_idx END AS INT) parent_idx,
    name, is_tip, branch_len + t.range * CAST(0.01 AS DOUBLE) branch_len FROM tree_nodes CROSS JOIN range(20) t)"""
_CLOSURE = """,
up AS (SELECT tree_id, node_idx anc, parent_idx nxt, node_idx AS descn, 0 hops, CAST(0.0 AS DOUBLE) dist FROM forest
  UNION ALL SELECT up.tree_id, t.node_idx, t.parent_idx, up.descn, up.hops + 1, up.dist + c.branch_len
  FROM up JOIN forest t ON t.tree_id = up.tree_id AND t.node_idx = up.nxt JOIN forest c ON c.tree_id = up.tree_id AND c.node_idx = up.anc)"""
_MASKS = """,
masks AS (SELECT up.tree_id, up.anc node_idx, list(up.descn ORDER BY up.descn) tips, count(*) n_tips, max(up.dist) height
  FROM up JOIN forest f ON f.tree_id = up.tree_id AND f.node_idx = up.descn AND f.is_tip GROUP BY up.tree_id, up.anc)"""
_SPLITS = """,
whole AS (SELECT tree_id, list(node_idx ORDER BY node_idx) m FROM forest WHERE is_tip GROUP BY tree_id),
splits AS (SELECT f.tree_id, array_to_string(CASE WHEN k.tips[1] = w.m[1] THEN list_filter(w.m, lambda x: NOT list_contains(k.tips, x)) ELSE k.tips END, ',') split, f.branch_len, k.height
  FROM forest f JOIN masks k ON k.tree_id = f.tree_id AND k.node_idx = f.node_idx JOIN whole w ON w.tree_id = f.tree_id
  WHERE NOT f.is_tip AND f.parent_idx IS NOT NULL)"""
_WAYS = """,
tip AS (SELECT up.* FROM up JOIN forest f ON f.tree_id = up.tree_id AND f.node_idx = up.descn AND f.is_tip)"""
_MATRIX = """,
ways AS (SELECT a.tree_id, a.descn tip, b.descn other, {} d, row_number() OVER (PARTITION BY a.tree_id, a.descn, b.descn ORDER BY a.hops + b.hops) r
  FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.anc = b.anc)
SELECT tree_id, tip, string_agg(CASE WHEN tip = other THEN '-' ELSE printf('%.6f', d) END, ' ' ORDER BY other) distances FROM ways WHERE r = 1 GROUP BY tree_id, tip"""
_PATHS = """,
paths AS (SELECT tree_id, descn node_idx, CAST(max(hops) AS INT) depth, string_agg(lpad(CAST(anc AS VARCHAR), 9, '0'), '/' ORDER BY hops DESC) path FROM up GROUP BY tree_id, descn)"""

SQL = {
    "tree_traversal": _FOREST + _CLOSURE + _PATHS + """
      SELECT tree_id, node_idx, depth, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS INT) pre_order,
        CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path || '~') - 1 AS INT) post_order FROM paths""",
    "tree_closure": _FOREST + _CLOSURE + ' SELECT tree_id, anc, descn AS "desc", CAST(hops AS INT) hops, round(dist, 6) dist FROM up',
    "patristic_distance": _FOREST + _CLOSURE + """,
      tip AS (SELECT up.* FROM up JOIN forest f ON f.tree_id = up.tree_id AND f.node_idx = up.descn AND f.is_tip),
      both_ AS (SELECT a.tree_id, a.descn tip_a, b.descn tip_b, a.anc, CAST(a.hops + b.hops AS INT) edges, a.dist + b.dist dist
        FROM tip a JOIN tip b ON a.tree_id = b.tree_id AND a.anc = b.anc AND a.descn < b.descn),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id, tip_a, tip_b ORDER BY edges) r FROM both_)
      SELECT tree_id, tip_a, tip_b, anc mrca, edges, round(dist, 6) dist FROM ranked WHERE r = 1""",
    "patristic_matrix": _FOREST + _CLOSURE + _WAYS + _MATRIX.format("a.dist + b.dist"),
    "patristic_to_mrca": _FOREST + _CLOSURE + _WAYS + _MATRIX.format("a.dist"),
    "deep_trees": """
      WITH o AS (SELECT ascii(o_orderstatus) tree_id, CAST(o_orderkey AS INT) k, CAST(o_custkey AS INT) c, floor(o_totalprice / CAST(10 AS DOUBLE)) / CAST(100 AS DOUBLE) len FROM orders),
      m AS (SELECT max(k) + 1 AS last FROM o),
      cust AS (SELECT tree_id, c, count(*) n, row_number() OVER (PARTITION BY tree_id ORDER BY c) - 1 depth FROM o GROUP BY tree_id, c),
      sums AS (SELECT *, sum(n) OVER w - n AS before, sum(n) OVER (PARTITION BY tree_id) AS tips, count(*) OVER (PARTITION BY tree_id) AS inner_ FROM cust WINDOW w AS (PARTITION BY tree_id ORDER BY c)),
      tip AS (SELECT o.*, s.depth, s.before, s.n, s.tips, s.inner_, row_number() OVER (PARTITION BY o.tree_id, o.c ORDER BY k) - 1 nth FROM o JOIN sums s ON s.tree_id = o.tree_id AND s.c = o.c)
      SELECT tree_id, k node_idx, CAST(depth + 1 AS INT) depth, CAST(depth + 1 + before + nth AS INT) pre_order, CAST(before + nth AS INT) post_order, CAST(1 AS BIGINT) AS size, CAST(1 AS BIGINT) n_tips, round(len + depth, 2) dist FROM tip
      UNION ALL SELECT tree_id, CAST(c + (SELECT last FROM m) AS INT), CAST(depth AS INT), CAST(depth + before AS INT), CAST(tips + inner_ - 1 - depth AS INT), CAST(tips - before + inner_ - depth AS BIGINT), CAST(tips - before AS BIGINT), CAST(depth AS DOUBLE) FROM sums""",
    "nodes_without_support": """
      WITH o AS (SELECT ascii(o_orderstatus) tree_id, CAST(o_orderkey AS INT) k, CAST(o_custkey AS INT) c FROM orders), m AS (SELECT max(k) + 1 AS last FROM o),
      cust AS (SELECT tree_id, c, count(*) n, min(k) lo, max(k) hi, row_number() OVER (PARTITION BY tree_id ORDER BY c) nth, count(*) OVER (PARTITION BY tree_id) AS of_, last_value(max(k)) OVER (PARTITION BY tree_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) far
        FROM o GROUP BY tree_id, c),
      f AS (SELECT *, n = 1 AND nth = of_ AS single FROM cust WHERE nth > 1 AND c % 3 <> 0)
      SELECT tree_id, CAST(c + (SELECT last FROM m) AS INT) node_idx, CASE WHEN single THEN 1 ELSE 0 END n_before, CASE WHEN single THEN 'o' || CAST(lo AS VARCHAR) END AS named,
        CASE WHEN NOT single THEN 'o' || CAST(lo AS VARCHAR) END leftmost, CASE WHEN NOT single THEN 'o' || CAST(far AS VARCHAR) END rightmost FROM f""",
    "outdegrees_rerooted": _FOREST + """,
      own AS (SELECT tree_id, parent_idx region FROM forest WHERE node_idx = 0),
      f AS (SELECT f.tree_id, f.node_idx, CASE WHEN f.node_idx = 0 THEN NULL WHEN f.node_idx = region THEN 0 WHEN f.node_idx = 30 THEN region ELSE f.parent_idx END parent_idx FROM forest f JOIN own USING (tree_id)),
      kids AS (SELECT f.tree_id, f.node_idx, count(c.node_idx) n_children FROM f LEFT JOIN f c ON c.tree_id = f.tree_id AND c.parent_idx = f.node_idx GROUP BY f.tree_id, f.node_idx)
      SELECT tree_id, n_children, count(*) n_nodes FROM kids GROUP BY tree_id, n_children""",
    "tree_dump": _FOREST + _CLOSURE + _PATHS + """
      SELECT tree_id, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS INT) pre_order, repeat('   ', depth) || CAST(node_idx AS VARCHAR) || ' ' || name || ' ' || printf('%.6f', branch_len) line
      FROM paths JOIN forest USING (tree_id, node_idx)""",
    "nhx_notes": _FOREST + """
      SELECT tree_id, name, 'node_idx' AS key, node_idx AS value FROM forest UNION ALL SELECT tree_id, name, 'parent_idx', parent_idx FROM forest WHERE parent_idx IS NOT NULL""",
    "streamed_splits": _FOREST + _CLOSURE + _MASKS + _SPLITS + " SELECT split, count(*) n_edges, round(avg(branch_len), 6) mean_len FROM splits GROUP BY split",
    "tree_labels": _FOREST + " SELECT name, count(DISTINCT tree_id) n_trees FROM forest GROUP BY name",
    "taxon_leaves": _FOREST + " SELECT tree_id, node_idx taxon_idx, node_idx FROM forest WHERE is_tip UNION ALL SELECT CAST(range AS INT), (SELECT max(node_idx) + 1 FROM forest WHERE is_tip), NULL FROM range(20)",
    "outdegree_histogram": _FOREST + """,
      kids AS (SELECT f.tree_id, f.node_idx, count(c.node_idx) n_children FROM forest f LEFT JOIN forest c ON c.tree_id = f.tree_id AND c.parent_idx = f.node_idx GROUP BY f.tree_id, f.node_idx)
      SELECT tree_id, n_children, count(*) n_nodes FROM kids GROUP BY tree_id, n_children""",
    "single_child_nodes": with_sql("tree_nodes") + " SELECT 0 tree_id, count(*) n_named, CAST(0 AS BIGINT) n_unnamed FROM tree_nodes WHERE parent_idx = 25",
    "tree_splits": _FOREST + _CLOSURE + _MASKS + _SPLITS + " SELECT tree_id, split, round(branch_len, 6) branch_len, round(height, 6) height FROM splits",
    "split_frequencies": _FOREST + _CLOSURE + _MASKS + _SPLITS + """
      SELECT split, count(*) n_trees, round(sum(branch_len), 6) sum_len, round(sum(branch_len * branch_len), 6) sum_len_sq, round(avg(branch_len), 6) mean_len,
        round(avg(height), 6) mean_height, round(count(*) / CAST(18 AS DOUBLE), 6) frequency FROM splits WHERE tree_id >= 2 GROUP BY split""",
    "unsupported_splits": (_FOREST + _CLOSURE + _MASKS + _SPLITS).replace("forest AS (", "forest0 AS (", 1).replace(",\nup AS (", """,
      forest AS (SELECT * FROM forest0 UNION ALL SELECT 20, node_idx, CASE WHEN node_idx = 4 THEN 26 ELSE parent_idx END, name, is_tip, branch_len FROM forest0 WHERE tree_id = 0),
      up AS (""", 1) + """
      SELECT DISTINCT split FROM splits a WHERE tree_id = 20 AND NOT EXISTS (SELECT 1 FROM splits b WHERE b.tree_id <> 20 AND b.split = a.split)""",
    "compared_nodes": _FOREST + _CLOSURE + _MASKS + """
      SELECT a.node_idx, array_to_string(list_filter(a.tips, lambda x: NOT list_contains(b.tips, x)), ',') only_a,
        array_to_string(list_filter(b.tips, lambda x: NOT list_contains(a.tips, x)), ',') only_b FROM masks a JOIN masks b ON a.node_idx = b.node_idx
      WHERE a.tree_id = 0 AND b.tree_id = 1 AND a.tips <> b.tips""",
    "tip_masks": _FOREST + _CLOSURE + _MASKS + " SELECT tree_id, node_idx, array_to_string(tips, ',') tips, n_tips FROM masks",
    "subtree_of_tips": _FOREST + _CLOSURE + """,
      holds AS (SELECT tree_id, anc FROM up WHERE descn IN (3, 8) GROUP BY tree_id, anc HAVING count(*) = 2),
      sizes AS (SELECT tree_id, anc, count(*) n FROM up GROUP BY tree_id, anc),
      top AS (SELECT h.tree_id, h.anc, row_number() OVER (PARTITION BY h.tree_id ORDER BY s.n, h.anc) r FROM holds h JOIN sizes s ON s.tree_id = h.tree_id AND s.anc = h.anc)
      SELECT up.tree_id, up.descn node_idx, up.anc AS top, CAST(up.hops AS INT) hops FROM up JOIN top ON top.tree_id = up.tree_id AND top.anc = up.anc AND top.r = 1""",
    "rerooted": _FOREST + """,
      tip AS (SELECT tree_id, parent_idx region, branch_len FROM forest WHERE node_idx = 7)
      SELECT f.tree_id, f.node_idx,
        CASE WHEN f.node_idx = 7 THEN NULL WHEN f.node_idx = tip.region THEN 7 WHEN f.node_idx = 30 THEN tip.region ELSE f.parent_idx END parent_idx,
        round(CASE WHEN f.node_idx = 7 THEN 0.0 WHEN f.node_idx = tip.region THEN tip.branch_len
          WHEN f.node_idx = 30 THEN (SELECT r.branch_len FROM forest r WHERE r.tree_id = f.tree_id AND r.node_idx = tip.region) ELSE f.branch_len END, 6) branch_len
      FROM forest f JOIN tip ON tip.tree_id = f.tree_id""",
    "tree_inspection": _FOREST + """
      SELECT tree_id, count(*) FILTER (WHERE is_tip) n_tips, count(*) FILTER (WHERE NOT is_tip) n_inner, round(sum(branch_len), 6) tree_length,
        string_agg(CASE WHEN is_tip THEN name END, ',' ORDER BY name) tip_names FROM forest GROUP BY tree_id""",
    "newick_text": with_sql("tree_nodes") + """,
      lab AS (SELECT node_idx, parent_idx, CASE WHEN regexp_matches(name, '[^A-Za-z0-9_.+-]') THEN '''' || name || '''' ELSE name END || '[&index=' || CAST(node_idx AS VARCHAR) || ']:' || printf('%.6f', branch_len) t FROM tree_nodes),
      regions_ AS (SELECT r.node_idx, '(' || string_agg(c.t, ',' ORDER BY c.node_idx) || ')' || r.t t FROM lab r JOIN lab c ON c.parent_idx = r.node_idx WHERE r.node_idx BETWEEN 25 AND 29 GROUP BY r.node_idx, r.t)
      SELECT 0 tree_id, '(' || string_agg(regions_.t, ',' ORDER BY regions_.node_idx) || ')' || (SELECT t FROM lab WHERE node_idx = 30) || ';' newick FROM regions_""",
    "newick_round_trip": _FOREST + " SELECT tree_id, node_idx, name, round(branch_len, 6) branch_len FROM forest",
}
