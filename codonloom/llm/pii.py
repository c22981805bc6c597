"""Operator 9: personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import table, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "iban", "secret", "login")
ORDER = {k: i for i, k in enumerate((*BASE, *ADDED))}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE_VALUE = re.compile(r"(?:\s|[:=#\"'.]|no\b|number\b|is\b){0,6}([A-Za-z0-9](?:[A-Za-z0-9_-]|[.+/~](?=[A-Za-z0-9_-])){4,}={0,2})", re.I)
#: At least the length of what may stand between a cue and its value.
_BETWEEN = 40
_IBAN = re.compile(r"[\s:=#.]{0,6}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_LOGIN = re.compile(r"([^\s/?#@:]+:[^\s/?#@]+)@")
#: Length of an account number -> the countries that have it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH_OF = {c: n for n, countries in _IBAN_LENGTHS.items() for c in countries.split()}
_CUES = {
    "account": ("account", "acct", "passport", "ssn", "routing"),
    "iban": ("iban",),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey"),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """At-signs, plus signs, digits, schemes with an authority, identifier cues."""
    found = ahocorasick.Automaton()
    for ch in "0123456789":
        found.add_word(ch, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    flat = value.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account number ends that starts at start and ends by end: between groups,
    at its country's length if that is valid, else at the longest valid length."""
    ends, n = [], 0
    for i in range(start, end):
        n += text[i] != " "
        after = text[i + 1 : i + 2]
        if text[i] != " " and not ("A" <= after <= "Z" or "0" <= after <= "9"):
            ends.append((n, i + 1))
    own = _LENGTH_OF.get(text[start : start + 2])
    return next((e for n, e in sorted(ends, key=lambda x: (x[0] != own, -x[0])) if iban_ok(text[start:e])), None)


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points, end exclusive, by
    start and kind. From each anchor a parser expands to the longest span that its
    kind allows, leftmost first; what a rejected span covers is not tried again."""
    spans: list[tuple[str, int, int]] = []
    email_at = ip_at = card_at = phone_at = 0
    taken = {k: 0 for k in ADDED}
    for last, (what, length) in automaton().iter(text):
        i = last - length + 1
        if what == "digit":
            if i >= card_at:
                if m := _CARD.match(text, i):
                    card_at = m.end()
                    if 14 <= card_at - i:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            spans.append(("card", i, card_at))
                else:
                    card_at = i + 1
            if i >= ip_at:
                if m := _IP.match(text, i):
                    ip_at = m.end()
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.groups())):
                        spans.append(("ip", i, ip_at))
                else:
                    ip_at = _DIGITS.match(text, i).end()
        elif what == "plus":
            if i >= phone_at and (m := _PHONE.match(text, i)):
                phone_at = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append(("phone", i, phone_at))
        elif what == "at":
            start = i
            while start > email_at and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                email_at = m.end()
                spans.append(("email", start, email_at))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                spans.append(("login", last + 1, m.end(1)))
        elif last >= taken[what] and not (i and text[i - 1].isalnum()):
            m = (_IBAN if what == "iban" else _CUE_VALUE).match(text, last + 1)
            if m and m.start(1) > last + 1:
                start, end = m.span(1)
                if what == "iban":
                    end = iban_end(text, start, end)
                elif sum(c.isdigit() for c in m[1]) < 4:
                    taken[what], end = end - _BETWEEN, None  # a value that starts in this one has no more digits
                if end is not None:
                    taken[what] = end
                    spans.append((what, start, end))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_text(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find(text)
        base = [s for s in spans if s[0] in BASE]
        counts = [sum(s[0] == k for s in base) for k in BASE]
        rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its spans; no shuffle.

    Null text: as empty; empty texts have no spans. Repeated rows and null ids: each row
    on its own. Ties: spans of different kinds may overlap or be equal, and all stay.
    Empty table: empty result. Long texts and runs of digits: whole, in time linear in
    their length. Other columns: not read, so their names don't matter.
    Kinds beyond the base four (account, iban, secret, login) only add spans.
    """
    scanned = F.pandas_udf(scan_text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    found = docs.select(F.col(id_col).alias("doc_id"), scanned(text_of(docs, text_col)).alias("r"))
    return found.select("doc_id", "r.n_email", "r.n_ip", "r.n_card", "r.n_phone", "r.base_sha256", "r.spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
