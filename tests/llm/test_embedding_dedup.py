import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from codonloom.llm.components import connected_components
from codonloom.llm.embedding_dedup import BLOCK, MultiIndex, cells_of, fit_index, link_embeddings, query, traverse

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, copies int"


def brute(rows, cosine=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, parent = defaultdict(set), {}
    groups = defaultdict(list)
    for i, r in enumerate(ok):
        groups[r[2], len(r[1])].append(i)
    for members in groups.values():
        x = np.stack([np.array(ok[i][1], dtype=float) for i in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                links[members[a]].add(members[b])
    out = []
    for i in range(len(ok)):
        if i not in parent:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            least = min((ok[j][0] for j in seen if ok[j][0] is not None), default=None)
            parent |= dict.fromkeys(seen, least)
        out.append((ok[i][0], len(links[i]), parent[i], ok[i][0] == parent[i]))
    return out, sum(len(v) for v in links.values())


def test_recall_on_the_table(spark):
    """The whole table and, for every tenth vector, a copy at a cosine just above the threshold."""
    d = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert query(spark, d).count() == len(rows)
    rng = np.random.default_rng(9)
    for i, v, label in rows[::10]:
        x = np.array(v) / np.linalg.norm(v)
        y = rng.standard_normal(len(x))
        y -= (y @ x) * x
        c = rng.uniform(0.9305, 0.96)
        rows.append((100_000 + i, [float(z) for z in c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)], label))
    want, n = brute([(a, [np.float32(z) for z in b], c) for a, b, c in rows])
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert n >= len(rows) // 11 and 0.97 * n <= found <= n
    assert np.mean([tuple(a) == b for a, b in zip(sorted(got), sorted(want), strict=True)]) > 0.97


def test_hot_group_and_awkward_rows(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.05 * rng.standard_normal(16)], 1) for i in range(3 * BLOCK)]
    rows += [(5000 + i, [float(x) for x in rng.standard_normal(16)], i % 3) for i in range(400)]
    rows += [(6000 + i, rows[0][1], 1) for i in range(50)] + [rows[7], rows[7]]
    rows += [(7000, None, 1), (7001, [0.0] * 16, 1), (7002, [float("nan")] + [1.0] * 15, 1), (7003, [None] + [1.0] * 15, 1), (7004, [], 1), (7005, rows[0][1], None)]
    rows += [(None, [1.0, 2.0], 5), (7006, [2.0, 4.0], 5), (7007, [-2.0, 4.0], 5), (None, None, None), (7008, [float("inf")] * 16, 1)]
    full = [(*r, "x", 9) for r in rows]
    got = {}
    for r in link_embeddings(spark.createDataFrame(full, SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    want, _ = brute([(a, None if b is None else [None if x is None else np.float32(x) for x in b], c) for a, b, c in rows])
    assert sum(map(len, got.values())) == len(rows)
    for i, n, c, k in want:
        assert (n, c) in [(x[0], x[1]) for x in got[i]]
        if i is not None:
            assert k == got[i][0][2]
    for i in (7000, 7001, 7002, 7003, 7004, 7005, 7008):
        assert got[i] == [(0, i, True)]
    assert link_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(1, 60))
def test_traversal_takes_the_nearest_pairs(a, b, visits):
    a, b = sorted(a), sorted(b)
    got = list(traverse(a, b, visits))
    assert len(set(got)) == len(got) == min(visits, len(a) * len(b))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(x + y for x in a for y in b)[: len(got)]


def test_memory_of_a_fine_index():
    """256 centres a half, as for 50 million vectors: neither the driver nor a worker holds the grid."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 64))
    tracemalloc.start()
    index = fit_index(x, 52_000_000)
    assert index.first.shape == index.second.shape == (256, 32)
    driver, _ = tracemalloc.get_traced_memory()[1], tracemalloc.reset_peak()
    vectors = pa.array(list(x[:10_000].astype(np.float32)), pa.list_(pa.float32()))
    ids = pa.array(range(10_000), pa.int64())
    out = next(cells_of(index)(iter([pa.RecordBatch.from_arrays([ids, ids, ids, vectors], names=["rid", "label", "copies", "vector"])])))
    worker = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert driver < 300 << 20 and worker < 300 << 20, (driver, worker)
    assert len(out.column(5)[0]) == index.visits
    assert fit_index(x, 10**10).first.shape[0] == 4096  # cells grow with the vectors


def test_nearest_cells_equal_the_whole_grid():
    rng = np.random.default_rng(2)
    index = MultiIndex(rng.standard_normal((9, 3)), rng.standard_normal((7, 4)), 0)
    x = rng.standard_normal((50, 7))
    grid = ((x[:, None, :3] - index.first) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - index.second) ** 2).sum(2)[:, None, :]
    assert (index.nearest_cells(x, 20) == grid.reshape(50, -1).argsort(axis=1)[:, :20]).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 101)}, **{i: 200 for i in range(201, 260)}, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
