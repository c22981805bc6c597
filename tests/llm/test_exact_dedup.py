import hashlib
import re
import shutil
from collections import defaultdict

import cases
from pyspark.sql import functions as F

from codonloom.llm import exact_dedup
from codonloom.llm.common import stable, with_row_id
from codonloom.llm.exact_dedup import drop_exact_copies, exact_groups, query


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, len(text or "")))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            out[i, hashlib.sha256(norm.encode()).hexdigest()] = (keep, len(members))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    got = query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
        assert r.kept == (r.doc_id == r.keep_id)


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    rows = [(r[0], r[1]) for r in cases.rows()]
    want, got = brute(rows), query(spark, d).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        assert want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}  # one row of each group, repeated rows included
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len(kept)
    assert len(cases.values(docs.exceptAll(out))) == len(rows) - len(kept) and not cases.values(out.exceptAll(docs))


def test_empty(spark):
    assert exact_groups(cases.empty(spark)).count() == 0
    assert drop_exact_copies(cases.empty(spark)).count() == 0


def test_row_numbers(spark, tmp_path):
    """The same for any split of the files, wherever they lie; other inputs are written first."""
    spark.range(5000).withColumn("t", F.repeat(F.lit("x"), 2000)).repartition(40).write.parquet(str(tmp_path / "a b"))
    shutil.copytree(tmp_path / "a b", tmp_path / "c")
    docs = spark.read.parquet(str(tmp_path / "a b"))
    some = docs.filter("id % 2 = 0").select("id")
    assert stable(docs) is docs and stable(some) is some
    assert stable(docs.repartition(3)) is not docs and stable(spark.read.parquet(*[str(tmp_path / "c")] * 2)).count() == 10_000
    found = {}
    for n, df in ((1, docs), (4, docs), (7, some), (None, spark.read.parquet(str(tmp_path / "c")))):
        cases.parallelism(spark, n)
        rows = {r.id: r["_rid"] for r in with_row_id(df).collect()}
        assert len(set(rows.values())) == len(rows)
        found |= rows if not found else {}
        assert all(found[i] == r for i, r in rows.items())
    assert min(found.values()) >= 0


def test_other_cores_between_jobs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = cases.values(drop_exact_copies(docs).select("doc_id"))
    rows, n = exact_dedup.with_row_id, iter((2, 5))

    def moving(*args):
        cases.parallelism(spark, next(n))
        return rows(*args)

    monkeypatch.setattr(exact_dedup, "with_row_id", moving)
    assert cases.values(drop_exact_copies(docs).select("doc_id")) == want
    cases.parallelism(spark, None)
