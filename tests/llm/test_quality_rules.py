import re
from collections import Counter

import cases
import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from codonloom.llm.quality_rules import BASE, BIT, POLICIES, RULES, SQL, Policy, ablation, judged, ledger, measure, query, repeated_words


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words_equal_brute_force(words):
    assert repeated_words(words) == brute_repeats(words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab#* \n\t\r.-…• é"), max_size=60))
def test_measures_equal_brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    assert measure(text)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, brute_repeats(words))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, query(spark, sf).select(*names).collect())) == sorted(want)


def test_awkward_rows(spark, tmp_path):
    d = cases.stored(cases.documents(spark), tmp_path)
    got = sorted(map(tuple, query(spark, d).select("doc_id", "n_words", "word_chars", "base_failed", "kept").collect()), key=repr)
    want = []
    for r in cases.rows():
        n, chars, *_ = m = measure(r[1] or "")
        failed = n < 50 or 100 * m[4] > 50 * n
        want.append((r[0], n, chars, failed))
        assert m[1] == len(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""))
    assert [g[:4] for g in got] == sorted(want, key=repr)
    assert not any(g[3] and g[4] for g in got)
    assert query(spark, cases.stored(cases.empty(spark), tmp_path / "none")).count() == 0


def test_policies_and_ablation(spark, sf):
    rows = ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r.failures for r in rows.select("failures").collect()]
    policies = [*POLICIES.values(), Policy("x", hard=("symbols",), soft=("few_words", "bullets", "ellipses"), allowed=1)]

    def kept(b, p):
        return not any(b & BIT[r] for r in p.hard) and sum(bool(b & BIT[r]) for r in p.soft) <= p.allowed

    got = {(r.version, r.rule): tuple(r)[2:] for r in ablation(rows, policies).collect()}
    assert len(got) == len(policies) * len(RULES)
    for p in policies:
        for rule, bit in BIT.items():
            a, b = [kept(x, p) for x in bits], [kept(x & ~bit, p) for x in bits]
            assert got[p.version, rule] == (len(bits), sum(bool(x & bit) for x in bits), sum(a), sum(b), sum(y and not x for x, y in zip(a, b)))
        verdict = judged(rows, p).select("failures", "base_failed", "kept").collect()
        assert all(r.base_failed == any(r.failures & BIT[x] for x in BASE) and r.kept == (kept(r.failures, p) and not r.base_failed) for r in verdict)
    assert ablation(ledger(cases.empty(spark)), policies).count() == 0


def test_most_documents_stay(spark):
    rows = query(spark, "/root/testdata/sf0.01").collect()
    lost = sum(not r.base_failed and not r.kept for r in rows)
    assert lost < 0.05 * len(rows)
