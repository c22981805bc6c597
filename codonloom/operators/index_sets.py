"""Named sets of indices: expressions, labels, sets in sets, ranges and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonloom.operators.lineage import cut, small

_WORD = r"'[^']*+(?:''[^']*+)*+'|[^\s'\\\-]++"
_ITEM = rf"((?:{_WORD})(?:\s*+-\s*+(?:{_WORD})(?:\s*+\\\s*+(?:{_WORD}))?+)?+)"
_PARTS = [rf"^({_WORD})", rf"^(?:{_WORD})\s*-\s*({_WORD})", r"\\\s*([^\\]+)$"]
_NUMBER = r"^\d{1,9}$"


def plain(word: Column) -> Column:
    """A word as names are compared: without its quotes, doubled quotes as one, in
    capitals, underscores as blanks."""
    inside = F.replace(F.regexp_replace(word, "^'|'$", ""), F.lit("''"), F.lit("'"))
    return alike(F.when(word.startswith("'"), inside).otherwise(word))


def alike(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit("_"), F.lit(" ")))


def fail(*parts: Column | str) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def items(definitions: DataFrame) -> DataFrame:
    """name, a, b, step: the items of each definition; b and step null where there are none."""
    rest = F.trim(F.regexp_replace(F.regexp_replace("definition", _ITEM, ""), r"\s", ""))
    whole = F.when(rest != "", fail("not a set: ", F.col("definition"))).otherwise(F.regexp_extract_all("definition", F.lit(_ITEM), 1))
    each = definitions.select("name", F.explode(whole).alias("i"))
    a, b, step = (F.regexp_extract("i", p, 1) for p in _PARTS)
    return each.select("name", plain(a).alias("a"), F.when(b != "", plain(b)).alias("b"), F.when(F.col("i").contains("\\") & (b != ""), step).alias("step"))


def members(references: DataFrame, direct: DataFrame) -> DataFrame:
    """(name, ref) and (ref, idx) to (name, idx): what is reached over any number of
    references, which double in length each round. A set that reaches itself is an error."""
    reach = cut(references.distinct())
    while True:
        if not reach.filter("name = ref").isEmpty():
            raise ValueError("a set contains itself")
        further = reach.join(reach.select(F.col("name").alias("ref"), F.col("ref").alias("_far")), "ref").select("name", F.col("_far").alias("ref"))
        more = cut(reach.union(further).distinct())
        if more.count() == reach.count():
            return reach.join(direct, "ref").select("name", "idx")
        reach = more


def expand(definitions: DataFrame, last: int, labels: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(name, definition) to (name, idx), one-based: ``ALL``, ``7``, ``3-9``, ``3-.``, ``3-9\\2``,
    labels and names of sets, in any case, quoted if need be.

    labels: (label, idx); a label may stand for its index, at the ends of a range too.
    sets: (name, idx) defined elsewhere. Where name is a string, definitions may also
    name each other, in any order. A word that is none of these, an index beyond the
    last, a range that runs backwards, a bad step and a set that contains itself fail.
    Two sets of one name are read as one.
    """
    spark, own = definitions.sparkSession, definitions.schema["name"].dataType.simpleString() == "string"
    definitions = cut(definitions)
    found = items(definitions)
    known = cut(labels.select(alike(F.col("label")).alias("_l"), F.col("idx").cast("long").alias("_i"))) if labels is not None else spark.createDataFrame([], "_l string, _i long")
    named = sets.select(alike(F.col("name")).alias("_s")).distinct() if sets is not None else spark.createDataFrame([], "_s string")
    if own:
        named = named.union(definitions.select(alike(F.col("name")))).distinct()
    known, named = small(known), small(cut(named))
    found = found.join(known.withColumnRenamed("_l", "a").withColumnRenamed("_i", "_la"), "a", "left").join(known.withColumnRenamed("_l", "b").withColumnRenamed("_i", "_lb"), "b", "left")
    found = found.join(named.withColumnRenamed("_s", "a").withColumn("_set", F.lit(True)), "a", "left")

    def index(word: str, label: str) -> Column:
        return F.when(F.col(label).isNotNull(), F.col(label)).when(F.col(word).rlike(_NUMBER), F.col(word).cast("long"))

    every, open_end = F.col("a") == "ALL", F.coalesce(F.col("b") == ".", F.lit(False))
    low, single = F.when(every, F.lit(1).cast("long")).otherwise(index("a", "_la")), F.col("b").isNull()
    high = F.when(every | open_end, F.lit(last).cast("long")).when(single, low).otherwise(index("b", "_lb"))
    step = F.when(F.col("step").isNull(), 1).when(F.trim("step").rlike(_NUMBER), F.trim("step").cast("int"))
    found = cut(found.select("name", "a", "b", low.alias("lo"), high.alias("hi"), F.coalesce(step, F.lit(0)).alias("step"), (low.isNull() & single & F.coalesce("_set", F.lit(False))).alias("is_set")))
    wrong = (
        F.when(F.col("lo").isNull(), fail("no index, label or set: ", F.col("a"))).when(F.col("hi").isNull(), fail("a range must end with an index or label: ", F.col("b")))
        .when(F.col("step") < 1, fail("not a step, after ", F.col("a"))).when(F.col("hi") < F.col("lo"), fail("a range runs backwards: ", F.col("a")))
        .when((F.col("lo") < 1) | (F.col("hi") > last), fail("beyond the last index: ", F.col("a")))
    )
    ranges_ = F.coalesce(wrong.cast("array<int>"), F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"), F.col("step")))
    direct = found.filter("NOT is_set").select("name", F.explode(ranges_).alias("idx"))
    out = direct
    if own or sets is not None:
        refs = found.filter("is_set").select("name", F.col("a").alias("ref"))
        outside = sets.select(alike(F.col("name")).alias("ref"), F.col("idx").cast("int").alias("idx")) if sets is not None else None
        if own:
            pool = direct.select(alike(F.col("name")).alias("ref"), "idx")
            spelled = definitions.select("name", alike(F.col("name")).alias("_n")).distinct()
            reached = members(refs.select(alike(F.col("name")).alias("name"), "ref"), pool.union(outside) if outside is not None else pool)
            out = out.union(reached.withColumnRenamed("name", "_n").join(spelled, "_n").select("name", "idx"))
        else:
            out = out.union(refs.join(outside, "ref").select("name", "idx"))
    return out.distinct()


def expand_partition(definitions: DataFrame, last: int, labels: DataFrame | None = None, sets: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(name, definition) with ``subset: set, subset: set`` to (name, subset, idx). Weight
    sets have the same form: their subsets are the weights. An index in two subsets
    and a subset that comes twice fail; with ``whole`` an index in none does too."""
    text = r"((?:[^,']++|'[^']*+')++)"
    part = definitions.select("name", F.posexplode(F.regexp_extract_all("definition", F.lit(text), 1)).alias("_k", "_p"))
    head = F.regexp_extract("_p", r"^\s*('[^']*+(?:''[^']*+)*+'|[^:']*+)\s*:", 1)
    subset = F.when(head == "", fail("no subset: ", F.col("_p"))).otherwise(F.trim(head))
    bare = F.when(subset.startswith("'"), F.replace(F.regexp_replace(subset, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(subset)
    body = F.trim(F.regexp_replace("_p", r"^\s*(?:'[^']*+(?:''[^']*+)*+'|[^:']*+)\s*:", ""))
    one = cut(part.select(F.struct("name", bare.alias("subset"), "_k").alias("name"), body.alias("definition")))
    if not one.groupBy("name.name", F.upper("name.subset")).count().filter("count > 1").isEmpty():
        raise ValueError("a subset comes twice")
    return complete(expand(one, last, labels, sets).select("name.name", "name.subset", "idx"), last, whole)


def expand_vector(definitions: DataFrame, last: int, whole: bool = True) -> DataFrame:
    """(name, definition) in vector form to (name, subset, idx): the k-th word is the
    subset of index k. More words than indices fail; with ``whole`` fewer do too."""
    words = definitions.select("name", F.posexplode(F.regexp_extract_all("definition", F.lit(r"('[^']*+(?:''[^']*+)*+'|[^\s']++)"), 1)).alias("_k", "_w"))
    subset = F.when(F.col("_w").startswith("'"), F.replace(F.regexp_replace("_w", "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.col("_w"))
    idx = F.when(F.col("_k") >= last, fail("more entries than indices").cast("int")).otherwise(F.col("_k") + 1)
    return complete(words.select("name", subset.alias("subset"), idx.alias("idx")), last, whole)


def complete(partition: DataFrame, last: int, whole: bool) -> DataFrame:
    """The partition, checked: no index twice, and with ``whole`` each of them once."""
    once = partition.groupBy("name", "idx").agg(F.min("subset").alias("subset"), F.count(F.lit(1)).alias("_n"))
    name = F.col("name").cast("string")
    checked = once.select("name", F.when(F.col("_n") > 1, fail("an index in several subsets of ", name).cast("string")).otherwise(F.col("subset")).alias("subset"), "idx")
    if not whole:
        return checked
    checked = cut(checked)
    if not checked.groupBy("name").count().filter(F.col("count") < last).isEmpty():
        raise ValueError("a partition lacks an index")
    return checked


def ranges(sets: DataFrame) -> DataFrame:
    """(name, idx) to (name, definition): maximal runs ``a-b`` and single indices."""
    island = F.col("idx") - F.row_number().over(Window.partitionBy("name").orderBy("idx"))
    runs = sets.withColumn("_i", island).groupBy("name", "_i").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    in_order = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy("name").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), " ").alias("definition"))


def overlaps(partition: DataFrame) -> DataFrame:
    """Indices that more than one subset of a partition holds; none if it is valid."""
    return partition.groupBy("name", "idx").agg(F.count_distinct("subset").alias("n_subsets")).filter("n_subsets > 1")
