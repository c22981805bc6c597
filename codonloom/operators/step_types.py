"""User-defined step matrices of character states, and changes weighed by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonloom.operators import trees as tr
from codonloom.operators.lineage import cut, small, stored
from codonloom.operators.ordered import running


def tree_edges(types: DataFrame) -> DataFrame:
    """(name, newick) to (name, a, b, steps): the edges of state trees, whose nodes, inner
    ones too, are named after states. An edge without a length is one step; unnamed
    nodes have names of their own, which no state has."""
    numbered = cut(types.select(F.xxhash64("name").alias("tree_id"), "name", "newick"))
    nodes = cut(tr.parse_newick(numbered.select("tree_id", "newick")))
    state = F.coalesce("name", F.concat(F.lit("\t"), F.col("node_pos").cast("string")))
    own = nodes.select("tree_id", "node_pos", "parent_pos", state.alias("a"), "branch_len")
    up = own.select("tree_id", F.col("node_pos").alias("parent_pos"), F.col("a").alias("b"))
    steps = F.when(F.contains("newick", F.lit(":")), F.col("branch_len")).otherwise(F.lit(1.0))
    return own.join(up, ["tree_id", "parent_pos"]).join(numbered, "tree_id").select("name", "a", "b", steps.alias("steps"))


def shortest_steps(edges: DataFrame) -> DataFrame:
    """(name, a, b, steps) to the least steps between any two states of a type, both ways:
    min-plus products of the matrix with itself until none is shorter, so as many as
    the longest way has binary digits. States without a way between them have no row."""
    both = edges.select("name", "a", "b", "steps").union(edges.select("name", "b", "a", "steps"))
    selves = both.select("name", "a", F.col("a").alias("b"), F.lit(0.0).alias("steps"))
    now = cut(both.union(selves).groupBy("name", "a", "b").agg(F.min("steps").alias("steps")))
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.round(F.sum("steps"), 9)).first()
        if tuple(state) == before:
            return now
        before = tuple(state)
        second = now.select("name", F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more"))
        ways = now.join(second, ["name", "b"]).groupBy("name", "a", "c").agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        now = cut(ways.withColumnRenamed("c", "b"))


def matrix_steps(types: DataFrame) -> DataFrame:
    """(name, definition) to (name, a, b, steps): ``n s1 .. sn`` and n rows of n cells; a
    point on the diagonal is 0, ``i`` no way and null. Too few or many cells fail."""
    words = types.select("name", F.regexp_extract_all("definition", F.lit(r"(\S++)"), 1).alias("w")).withColumn("n", F.expr("try_cast(w[0] AS INT)"))
    right = F.size("w") == 1 + F.col("n") + F.col("n") * F.col("n")
    cells = F.when(F.coalesce(right, F.lit(False)), F.slice("w", F.col("n") + 2, F.col("n") * F.col("n"))).otherwise(F.raise_error(F.lit("a step matrix needs its size, its states and all cells")).cast("array<string>"))
    states = words.withColumn("c", cells).select("name", "n", F.slice("w", F.lit(2), F.col("n")).alias("s"), F.posexplode("c").alias("k", "v"))
    at = lambda x: F.get("s", x.cast("int"))
    steps = F.when(F.col("v") == ".", 0.0).when(F.lower("v") != "i", F.col("v").cast("double"))
    return states.select("name", at(F.floor(F.col("k") / F.col("n"))).alias("a"), at(F.col("k") % F.col("n")).alias("b"), steps.alias("steps"))


def weighted_changes(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """taxon_a, taxon_b, n_sites, steps, n_barred: for each two taxa the sum of the steps
    from the one's state to the other's over all sites where both are known, and the
    sites that no way joins. cells: (taxon_idx, site, state); steps: (a, b, steps)."""
    known = cells.filter("state IS NOT NULL")
    a = known.select("site", F.col("taxon_idx").alias("taxon_a"), F.col("state").alias("a"))
    b = known.select("site", F.col("taxon_idx").alias("taxon_b"), F.col("state").alias("b"))
    # Sites share pairs of states: they are counted before the matrix is joined.
    pairs = a.join(b, "site").filter("taxon_a < taxon_b").groupBy("taxon_a", "taxon_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(small(cut(steps.select("a", "b", "steps"))), ["a", "b"], "left")
    return joined.groupBy("taxon_a", "taxon_b").agg(
        F.sum("n").alias("n_sites"), F.coalesce(F.sum(F.col("n") * F.col("steps")), F.lit(0.0)).alias("steps"), F.sum(F.when(F.col("steps").isNull(), F.col("n")).otherwise(0)).alias("n_barred")
    )


def unsupported_nodes(trees: DataFrame, supported: DataFrame) -> DataFrame:
    """tree_id, node_idx, n_before, named, leftmost, rightmost: the inner nodes, not the root,
    that have no name and no support, and how to find them.

    supported: (tree_id, node_idx). A node with one child has its child's support; one
    whose chain of single children has a name is told by that, and left out. The others
    are described from the end of their chain, n_before nodes below: by its name
    (named), or by the first names on the way to its leftmost and rightmost tips.

    A way that always takes the first child is a run of nodes whose subtrees begin at one
    place in post-order, one that takes the last child such whose subtrees end at one place
    in pre-order. So what comes next on a way is a running best over its nodes from the
    deepest up: two sorts of the inner nodes, however long the ways are.
    """
    placed = tr.tour(trees, prints=False, keep=("name",))
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name"))
    held = supported.select("tree_id", "node_idx").distinct()
    kids = placed.filter("parent_idx IS NOT NULL").groupBy("tree_id", F.col("parent_idx").alias("node_idx")).agg(
        F.count(F.lit(1)).alias("n"), *[f(c, "pre_order").alias(f"{at}_{c}") for at, f in (("first", F.min_by), ("last", F.max_by)) for c in ("node_idx", "size")]
    )
    inner = placed.join(kids, ["tree_id", "node_idx"]).join(held.withColumn("_s", F.lit(True)), ["tree_id", "node_idx"], "left")
    inner = stored(inner.select("tree_id", "node_idx", F.col("parent_idx").isNull().alias("root"), "depth", (F.col("post_order") - F.col("size")).alias("begins"), (F.col("pre_order") + F.col("size")).alias("ends"),
                                name.isNotNull().alias("named"), F.coalesce("_s", F.lit(False)).alias("held"), *kids.columns[2:]))
    height, here = -F.col("depth"), F.struct((-F.col("depth")).alias("h"), F.col("node_idx").alias("node"))

    def tip(side: str) -> Column:
        """The first or last child if it has none itself."""
        return F.when(F.col(f"{side}_size") == 1, F.struct((height - 1).alias("h"), F.col(f"{side}_node_idx").alias("node")))

    single = F.col("n") == 1
    left = running(
        inner.select("tree_id", "node_idx", "root", "depth", "begins", "named", "held", "n", "first_node_idx", "first_size"), ["tree_id", "begins"], [F.desc("depth")], "max",
        stop=F.when(F.col("named"), here).otherwise(tip("first")), end=F.when(single, tip("first")).otherwise(here), _h=F.when(F.col("held"), height), _n=F.when(F.col("named") & single, height),
    )
    left = stored(left.select("tree_id", "node_idx", "root", "depth", "named", "stop", "end", "_h", "_n"))
    right = running(inner.select("tree_id", "node_idx", "depth", "ends", "named", "last_node_idx", "last_size"), ["tree_id", "ends"], [F.desc("depth")], "max", stop=F.when(F.col("named"), here).otherwise(tip("last")))
    told = F.coalesce(F.col("_h") >= F.col("end.h"), F.lit(False)) | F.coalesce(F.col("_n") >= F.col("end.h"), F.lit(False))
    shown = left.filter(~F.col("root") & ~F.col("named") & ~told).select("tree_id", "node_idx", (height - F.col("end.h")).cast("int").alias("n_before"), F.col("end.node").alias("end"))
    shown = shown.join(held.withColumnRenamed("node_idx", "end"), ["tree_id", "end"], "left_anti")  # an end without children
    for side, ways in (("left", left), ("right", right)):
        shown = shown.join(ways.filter("NOT named").select("tree_id", F.col("node_idx").alias("end"), F.col("stop.node").alias(side)), ["tree_id", "end"], "left")
    for at, as_ in (("end", "named"), ("left", "leftmost"), ("right", "rightmost")):
        names = placed.select("tree_id", F.col("node_idx").alias(at), name.alias(as_)).filter(F.col(as_).isNotNull())
        shown = shown.join(names, ["tree_id", at], "left")
    return shown.select("tree_id", "node_idx", "n_before", "named", *[F.when(F.col("named").isNull(), F.col(c)).alias(c) for c in ("leftmost", "rightmost")])
