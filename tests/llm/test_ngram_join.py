import itertools
from collections import defaultdict

import cases
import numpy as np

from codonloom.llm import ngram_join
from codonloom.llm.ngram_join import BLOCK, bands_for, drop_near_copies, join_documents, query
from codonloom.llm.shingles import MinHash, normalised, shingles


def gram_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=0.8):
    sets = [gram_set(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        count = defaultdict(int)
        for g in s:
            for j in at[g]:
                count[j] += 1
        for j, c in count.items():
            if j != i and c >= similarity * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i].add(j)
    out, done = [], {}
    for i in range(len(rows)):
        if i not in done:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            done |= dict.fromkeys(seen, least)
        out.append((rows[i][0], done[i], len(links[i])))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = query(spark, d).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(3 * BLOCK):
        w = list(words)
        for p in rng.choice(300, size=int(rng.integers(1, 9)), replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    got = join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {r[0]: r for r in brute(rows)}
    assert sum(r.n_links for r in got) >= 0.999 * sum(r[2] for r in want.values())
    assert all(r.n_links <= want[r.id][2] for r in got)
    assert all(r.class_id == want[r.id][1] for r in got)


def test_near_copies_behind_documents_with_the_same_passages(spark, monkeypatch):
    """Third documents come first in all bands of two near copies and fail against both."""
    monkeypatch.setattr(ngram_join, "BAND_BLOCK", 64)
    rng = np.random.default_rng(1)
    pool = [[f"p{i}_{k}" for k in range(60)] for i in range(8)]
    rows = [(i, sum((pool[p] for p in np.sort(rng.choice(8, size=5, replace=False))), []) + [f"f{i}_{k}" for k in range(200)]) for i in range(600)]
    w = sum(pool, [])
    rows += [(1000, w), (1001, [*w[:210], "changed", *w[211:]])]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = sorted(brute(rows))
    assert [r for r in want if r[2]] == [(1000, 1000, 1), (1001, 1000, 1)]
    got = join_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.id, r.class_id, r.n_links) for r in got) == want


def test_other_cores_between_jobs(spark, monkeypatch):
    """Every job, the last included, sees the table split in another way."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {i for i, least, _ in brute([tuple(r) for r in docs.select("doc_id", "text").collect()]) if i == least}
    once, n = ngram_join.cut, itertools.count(1)

    def moving(*args):
        out = once(*args)
        cases.parallelism(spark, 1 + next(n) % 7)
        return out

    monkeypatch.setattr(ngram_join, "cut", moving)
    assert {r.doc_id for r in drop_near_copies(docs).select("doc_id").collect()} == want
    cases.parallelism(spark, None)


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    rows = [(r[0], r[1]) for r in cases.rows()]
    got = query(spark, d).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute(rows), key=key)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = drop_near_copies(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in got)
    assert not cases.values(out.exceptAll(docs))
    assert join_documents(cases.empty(spark)).count() == 0
    assert drop_near_copies(cases.empty(spark)).count() == 0


def test_shingles_and_minhash():
    text = normalised("A b  c\nd e f a b c d e g ü 日本")
    n = len(text.split())
    assert len(shingles(text)) == n - 4 and len(np.unique(shingles(text))) == len(gram_set(text))
    assert len(shingles("a b")) == 1 and len(shingles("")) == 0
    assert len(set(shingles("a b").tolist() + shingles("b a").tolist() + shingles("ab").tolist())) == 3
    m = MinHash(40, 5, 1)
    x, y = (np.arange(a, a + 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for a in (0, 100))
    assert abs((m.minima(x) == m.minima(y)).mean() - 0.8) < 0.12
    assert 1 - (1 - 0.8**4) ** bands_for() >= 0.99999
