import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from codonloom.llm import conversation_repair
from codonloom.llm.conversation_repair import SQL, cheapest, damaged, query, repairs

SCHEMA = "conv_id long, turn long, role string, text string, _key string, alive int, kind string"


def machine(state, ch):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, ch))


def brute(turns):
    """Cost, audit, lines by a fold from the first turn, with the edits as text. turns: (role, text, fault)."""

    def better(best, state, x):
        if state is not None and (state not in best or x[:2] < best[state][:2]):
            best[state] = x

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                role = "assistant" if q == 2 else "user"
                better(best, machine(q, role[0]), (cost + 2, audit + "I", (*lines, role + ":")))
        return best

    best = inserted({0: (0, "", ())})
    for role, text, fault in turns:
        new = {}
        for q, (cost, audit, lines) in best.items():
            better(new, q, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                better(new, machine(q, role[:1]), (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                other = "assistant" if q == 2 else "user"
                better(new, machine(q, other[0]), (cost + 2 + cut, audit + "R", (*lines, f"{other}:{text}")))
        best = inserted(new)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    return cost, audit, "\n".join(lines)


def expected(rows):
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        convs[conv]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if harm == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, judged, n = set(), [], defaultdict(int)
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            judged.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, text = brute(judged)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def results(df):
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    return got


@pytest.mark.parametrize("length", range(4))
def test_every_short_conversation(length):
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "truncated")]
    for turns in itertools.product([*kinds, ("user", "blank")], repeat=length):
        symbols = bytes(8 if f == "blank" else 2 * "suat".index(r[0]) + (f == "truncated") for r, f in turns)
        assert cheapest(symbols) == brute([(r, "", f) for r, f in turns])[:2]


def test_long_conversations_and_other_blocks(monkeypatch):
    rng = random.Random(7)
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "truncated", "blank")]
    for block in (1, 3, 4):
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
        conversation_repair.blocks.cache_clear()
        conversation_repair.expanded.cache_clear()
        for n in (1, 4, 5, 17, 40, 500):
            turns = [rng.choice(kinds) for _ in range(n)]
            symbols = bytes(8 if f == "blank" else 2 * "suat".index(r[0]) + (f == "truncated") for r, f in turns)
            assert cheapest(symbols) == brute([(r, "", f) for r, f in turns])[:2]
    conversation_repair.blocks.cache_clear()
    conversation_repair.expanded.cache_clear()


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(query(spark, sf))
    assert got == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(SQL).fetchall()} == got


def awkward():
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", None), (7, None, "user", "a."), (7, 5, "", "b."), (8, 0, "system", ""), (9, -4, "user", "x" * 300_000)]
    rows += [(10, i % 3, rng.choice(["user", "assistant", None, "tool", "system"]), rng.choice(["Yes.", "No", " \t\n", None, "Ünï! "])) for i in range(60)]
    rows += [(11, i, "assistant", "same.") for i in range(3000)]  # one conversation with most rows
    rows += [(12, 4, "user", "again?")] * 50  # repeated rows
    rows += [(c, t, "uasx"[t % 4], rng.choice(["One. Two", "three!", ""])) for c in range(20, 40) for t in range(6)]
    return rows


def test_awkward_rows(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame([(*r, "k", 1, "z") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert results(query(spark, str(tmp_path))) == expected(rows)
    assert repairs(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_all_rows_dropped(spark):
    turns = [t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    got = repairs(damaged(spark.createDataFrame([(1, t, "user", "Hi.") for t in turns], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
