import re
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from codonloom.llm.common import cut
from codonloom.llm.mixing import mix, mixed_documents, query, ranked_sources


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    source_of = {i: s for i, _, s in docs}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    first = query(spark, sf).collect()
    assert len(first) == len(docs)
    check(first, docs)
    assert sorted(first) == sorted(query(spark, sf).collect())


def test_capped_sources(spark):
    docs = [(i, "w " * (1 + i % 7), "a" if i < 20 else "b" if i < 22 else "c" if i < 500 else None) for i in range(520)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mix(df).withColumnRenamed("_id", "doc_id").collect()
    check(out, docs)
    assert any(r.target == 3 * r.source_size for r in out)


def test_many_sources(spark):
    """No task holds all sources; each meets its target."""
    df = spark.range(300_000).select("id", F.lit("w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 150_000).alias("source")).withColumnRenamed("id", "doc_id")
    lean = cut(df.select(F.col("source"), F.lit(2).cast("long").alias("source_size")).distinct())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = cut(ranked_sources(lean), 150_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.rdd.getNumPartitions() > 1
    assert {r.weight: r["count"] for r in ranked.groupBy("weight").count().collect()} == {1.0: 50_000, 2.0: 50_000, 3.0: 50_000}
    out = mix(df).groupBy("source_size", "target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert sum(r.n for r in out) == 300_000 and sorted(r.target for r in out) == pytest.approx([2.0, 4.0, 6.0])
    assert all(r.taken == pytest.approx(r.n * r.target / 2) for r in out)


def test_one_row_many_times(spark):
    """A hot row is cut inside its copies."""
    docs = [(7, "w w", "a")] * 400 + [(i, "w " * 50, "b") for i in range(100, 140)]
    out = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken = sum(r.taken for r in out if r.source_size == 800)
    assert abs(taken - next(r.target for r in out if r.source_size == 800)) <= 1
    assert len({r.reps for r in out if r.source_size == 800}) == 2


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert query(spark, d).count() == len(cases.rows())
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert not cases.values(out.distinct().exceptAll(docs.distinct()))
    assert cases.values(out) == cases.values(mixed_documents(docs))
    assert mix(cases.empty(spark)).count() == 0
    assert mixed_documents(cases.empty(spark)).count() == 0
