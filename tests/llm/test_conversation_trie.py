import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from codonloom.llm.conversation_trie import SQL, query, trie
from codonloom.llm.ordered import hash_in_order, positions
from codonloom.llm.tree_contraction import subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string, _rid string, id int, _c string, depth int"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    for v in own.values():
        v.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
    own = {c: [t[1:] for t in v] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        built = tuple(own.get(head, [])[:h] + v[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = {k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest() for k in members}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha[k]) for k, m in members.items())


def results(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(query(spark, sf))
    assert got == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(con.execute(SQL).fetchall()) == got


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", None), (7, None, "user", "a."), (-3, 5, "", "b."), (-3, 6, "u", "c"), (8, 0, None, ""), (9, -4, "user", "x" * 300_000)]
    rows += [(10, i // 2, "assistant", f"t{i % 7}") for i in range(600)]  # a long one, with ties
    rows += [(12, 4, "user", "again?")] * 50  # repeated rows
    rows += [(c, t, "uasx"[t % 4], "same") for c in range(20, 60) for t in range(3)]  # copies
    rows += [(c, t, "u", rng.choice("ab")) for c in range(60, 120) for t in range(rng.randrange(1, 9))]
    spark.createDataFrame([(*r, "r", 1, "c", 2) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert results(query(spark, str(tmp_path))) == expected(rows)


def test_empty(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "caterpillar", "star", "random", "forest"])
def test_contraction_equals_brute_force(spark, shape):
    rng, n = random.Random(2), 700
    up = {
        "chain": lambda i: i - 1, "caterpillar": lambda i: i - 1 - (i % 2 == 0 and i > 1), "star": lambda i: 0,
        "random": lambda i: rng.randrange(i), "forest": lambda i: rng.randrange(max(0, i - 5), i) if i % 9 else None,
    }[shape]
    names = rng.sample(range(-(1 << 60), 1 << 60), n)
    parent, level = [None], [0]
    for i in range(1, n):
        p = up(i)
        parent.append(p)
        level.append(0 if p is None else level[p] + 1)
    value = [rng.randrange(100) for _ in range(n)]
    total = list(value)
    for i in reversed(range(n)):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    rows = [(names[i], None if parent[i] is None else names[parent[i]], level[i], value[i], 1) for i in range(n)]
    got = subtree_totals(spark.createDataFrame(rows, "id long, parent long, level long, v long, w long"), ["v", "w"])
    assert {r.id: r.v for r in got.collect()} == dict(zip(names, total))


def test_cycles_are_errors(spark):
    with pytest.raises(ValueError):
        subtree_totals(spark.createDataFrame([(1, 2, 0, 1), (2, 1, 1, 1)], "id long, parent long, level long, v long"), ["v"])


def test_positions_of_a_key_over_many_parts(spark):
    rows = positions(spark.range(5000).selectExpr("id % 3 * id % 2 AS k", "-id AS v"), "k", ["v"])
    by = defaultdict(list)
    for r in rows.collect():
        by[r.k].append((r.v, r["_pos"]))
    assert sum(map(len, by.values())) == 5000
    assert all([p for _, p in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())


def test_hashes_of_pieces(spark):
    rows = [(i % 4, i // 8, i // 4, str(i)) for i in range(200)]
    pieces = spark.createDataFrame(rows, "a long, b long, o long, p string")
    want = defaultdict(list)
    for a, b, o, p in sorted(rows, key=lambda r: r[2]):
        want[a, b].append(p)
    got = hash_in_order(pieces, ["a", "b"], "o", "p", "a long, b long").collect()
    assert {(r.a, r.b): r.sha256 for r in got} == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
