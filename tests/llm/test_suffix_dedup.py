import hashlib
import itertools

import cases
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from codonloom.llm import suffix_dedup
from codonloom.llm.suffix_array import permuted_prefixes, suffix_array
from codonloom.llm.suffix_dedup import batch_of, collapse, match_segments, query, remove_repeats, segments


def brute(rows, length=100):
    """rows in order of place: (id, bytes)."""
    seen, out = set(), []
    for i, b in rows:
        covered = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            w = hash(b[s : s + length])
            if w in seen:
                covered[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.append(False, covered).astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((i, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50), st.integers(1, 9))
def test_suffix_array(values, most):
    t = np.array([*values, 0])
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    sa = suffix_array(t)
    assert sa.tolist() == want
    plcp = permuted_prefixes(t, sa, most)
    for i, j in zip(want, want[1:], strict=False):
        n = 0
        while n < most and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
            n += 1
        assert plcp[j] == n


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in query(spark, d).collect())
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs])
    assert sum(w[2] for w in want) > 0
    assert got == want


def test_hot_anchor_and_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "HELD", 300)
    rng = np.random.default_rng(5)
    line, passage = "the very same line of sixty bytes in all of the documents 12", "".join(chr(97 + x) for x in rng.integers(0, 26, 700))
    rows = []
    for i in range(300):
        noise = ["".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(5, 130)))) for _ in range(3)]
        rows.append((int(rng.integers(0, 10_000)), noise[0] + line + noise[1] + (passage[int(rng.integers(0, 300)) :] if i % 3 == 0 else "") + noise[2]))
    rows += [(20_000 + i, "ab" * 400 + "é" * (i % 3) * 80) for i in range(6)] + [(30_000, "z" * 1500), (30_001, "z" * 1499 + "y")]
    rows = list(dict(rows).items())
    want = brute([(i, t.encode()) for i, t in sorted(rows)])
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == want


def test_crowded_anchors(spark):
    """Anchors beyond what a shard or a task holds: split by their sides, then by windows."""
    rng = np.random.default_rng(6)

    def noise(n):
        return "".join(chr(97 + x) for x in rng.integers(0, 26, n))

    line, long_line, tail = noise(60), noise(140), noise(90)
    rows = [(i, noise(120) + line + noise(120)) for i in range(200)]
    rows += [(1000 + i, noise(150) + long_line[: 101 + i % 40] + noise(150)) for i in range(200)]
    rows += [(2000 + i, noise(150) + line + tail[: 20 + i % 70] + noise(30)) for i in range(200)]
    rows += [(3000 + i, rows[3 * i][1][i:]) for i in range(50)]
    want = brute([(i, t.encode()) for i, t in rows])
    assert sum(w[2] > 0 for w in want) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shard, key_rows in ((4000, 10_000), (400, 10_000), (4000, 30), (1 << 20, 5)):
        assert sorted(tuple(r) for r in remove_repeats(docs, shard=shard, key_rows=key_rows).collect()) == want


def test_streamed_keys():
    """The same rows in batches of any size give the same runs and segments."""
    rng = np.random.default_rng(7)
    blocks = [rng.integers(97, 123, 180) for _ in range(12)]
    text = np.concatenate([np.append(blocks[b][: int(c)], rng.integers(97, 123, 9)) for b, c in zip(rng.integers(0, 12, 300), rng.integers(100, 180, 300), strict=True)]).astype(np.uint8)
    k, seg, wide, a, n = segments(text, np.zeros(0, np.uint64))
    cols, _ = collapse(k.view(np.int64), seg.view(np.int64), wide.view(np.int64), np.full(len(k), 1), np.full(len(k), 1), a.astype(np.int64), n)
    whole = pa.Table.from_batches([batch_of(*cols)])
    found = []
    for size in (len(k), 1000, 7, 1):
        out = pa.Table.from_batches(match_segments(1 << 20, 10**6)(iter(whole.to_batches(max_chunksize=size))))
        up = out.filter(pc.greater(out["n"], 0)).to_pydict()
        cover = np.zeros(len(text), bool)
        for at, m in zip(*(out.filter(pc.less(out["n"], 0)).to_pydict()[c] for c in ("a", "n")), strict=True):
            cover[at : at - m] = True
        found.append((sorted(zip(*up.values(), strict=True)), cover.tolist()))
    assert found[0][0] and any(found[0][1]) and all(f == found[0] for f in found)


def test_other_cores_between_jobs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(tuple(r) for r in remove_repeats(docs).collect())
    once, n = suffix_dedup.stored, itertools.count(1)

    def moving(*args):
        out = once(*args)
        cases.parallelism(spark, 1 + next(n) % 7)
        return out

    monkeypatch.setattr(suffix_dedup, "stored", moving)
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == want
    cases.parallelism(spark, None)


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    got = query(spark, d).collect()
    assert len(got) == len(cases.rows())
    order = sorted(cases.rows(), key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([(r[0], (r[1] or "").encode()) for r in order])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert remove_repeats(cases.empty(spark)).count() == 0
