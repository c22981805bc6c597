import random

import pytest

from codonloom.operators.index_sets import expand, expand_partition, expand_vector


def sets(df, *key):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in key) if len(key) > 1 else r[key[0]], set()).add(r.idx)
    return out


def made(spark, *rows):
    return spark.createDataFrame(rows, "name string, definition string")


def test_labels_and_sets_in_sets(spark):
    labels = spark.createDataFrame([("foo", 4), ("bar baz", 6), ("it's", 9), ("12", 2)], "label string, idx int")
    got = expand(made(spark, ("a", "5 FOO 7"), ("b", "bar_baz - 'it''s' a"), ("C", "b 1 - 3 \\ 2"), ("d", "c B All"), ("e", "12"), ("one two", "foo-."), ("f", "'ONE TWO' 1")), 10, labels)
    assert sets(got, "name") == {"a": {4, 5, 7}, "b": {4, 5, 6, 7, 8, 9}, "C": {1, 3, 4, 5, 6, 7, 8, 9}, "d": set(range(1, 11)), "e": {2}, "one two": set(range(4, 11)), "f": {1, *range(4, 11)}}


@pytest.mark.parametrize("definition", ["5 foo 7", "3-", "- 3", "7-3", "3-9\\0", "3-9\\x", "0", "11", "1-11", "a-x", "3 \\ 2"])
def test_what_is_no_set_fails(spark, definition):
    with pytest.raises(Exception, match="no index|not a set|a range|not a step|beyond"):
        expand(made(spark, ("a", definition)), 10).collect()


@pytest.mark.parametrize("rows", [[("a", "a")], [("a", "b 1"), ("b", "c"), ("c", "2 A")]])
def test_cycles_fail(spark, rows):
    with pytest.raises(ValueError, match="contains itself"):
        expand(made(spark, *rows), 10)


def test_long_chains_of_references(spark):
    n = 200
    got = sets(expand(made(spark, *[(f"s{i}", f"{i + 1} s{i + 1}") for i in range(n)], (f"s{n}", str(n + 1))), n + 1), "name")
    assert all(got[f"s{i}"] == set(range(i + 1, n + 2)) for i in range(n + 1))


def test_partitions(spark):
    labels = spark.createDataFrame([("x", 3)], "label string, idx int")
    known = spark.createDataFrame([("odd", 1), ("odd", 5)], "name string, idx int")
    got = expand_partition(made(spark, ("p", "a: odd x, 'b, c': 2 4, 1e-3: 6")), 6, labels, known, whole=True)
    assert sets(got, "name", "subset") == {("p", "a"): {1, 3, 5}, ("p", "b, c"): {2, 4}, ("p", "1e-3"): {6}}
    for bad, why in (("a: 1-3, b: 3", "several subsets"), ("a: 1, A: 2", "twice"), ("1 2 3", "no subset"), ("a: 1-6, b: nope", "no index")):
        with pytest.raises(Exception, match=why):
            expand_partition(made(spark, ("p", bad)), 6).collect()
    with pytest.raises(ValueError, match="lacks"):
        expand_partition(made(spark, ("p", "a: 1-5")), 6, whole=True)


def test_vectors(spark):
    rng = random.Random(1)
    words = [rng.choice(["a", "b", "'c d'"]) for _ in range(1000)]
    got = sets(expand_vector(made(spark, ("v", "  ".join(words))), 1000), "subset")
    assert got == {w.strip("'"): {i + 1 for i, x in enumerate(words) if x == w} for w in set(words)}
    with pytest.raises(Exception, match="more entries"):
        expand_vector(made(spark, ("v", "a b c")), 2, whole=False).collect()
    with pytest.raises(ValueError, match="lacks"):
        expand_vector(made(spark, ("v", "a b")), 3)
