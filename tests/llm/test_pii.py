import hashlib
import re

import cases
from hypothesis import given, settings
from hypothesis import strategies as st

from codonloom.llm.pii import BASE, find, joined, luhn, query

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@aZ_%:/¤é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in find(text) if s[0] in BASE] == brute(text)


def test_query_equals_brute_force(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in query(spark, sf).collect():
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


def test_added_kinds():
    text = 'token = "4d44c79e8bf7c557" account no: 00123456, IBAN GB82 WEST 1234 5698 7654 32, ftp://me:pw@host.org/'
    assert {k for k, _, _ in find(text)} >= {"secret", "account", "iban", "login"}


def added(text):
    return [(k, text[a:b]) for k, a, b in find(text) if k not in BASE]


def test_accounts_end_where_their_country_says():
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"):
        for after in ("", ", x", " BIC: COBADEFF", " The next", " 12345 67", " AND MORE WORDS IN CAPITALS"):
            assert added(f"IBAN {iban}{after}") == [("iban", iban)]
    assert added("IBAN DE89370400440532013001 BIC: x") == []


def test_long_secrets_and_logins():
    token, jwt = "ab12" * 24, f"eyJ{'a1' * 40}.eyJ{'b2' * 90}.{'c3' * 21}"
    for value in (token, jwt, "QUJD+123/45678=="):
        assert added(f"token: {value} and") == [("secret", value)] and added(f'password="{value}".') == [("secret", value)]
    assert added("secret.token: abcd12345. Next") == [("secret", "abcd12345")]
    assert added(f"ftp://{'u' * 70}:{'p' * 200}@host.org/") == [("login", f"{'u' * 70}:{'p' * 200}")]
    assert added("token." * 50_000) == []


def test_awkward_rows(spark, tmp_path):
    assert query(spark, cases.stored(cases.documents(spark), tmp_path)).count() == len(cases.rows())
    assert query(spark, cases.stored(cases.empty(spark), tmp_path / "e")).count() == 0
