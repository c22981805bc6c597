"""Operator 11: quality rules as a ledger of failure bits, and policies that read it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import stored, table, text_of

_WORD = re.compile(r"[^ \t-\r]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: An ASCII letter or anything beyond ASCII.
_LETTER = re.compile(r"[A-Za-z\x80-\U0010ffff]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullets", "n_ellipses", "n_lettered", "longest_word")

#: Rule by bit, from 0 up: its name and the condition of failure, in whole numbers, that
#: Spark and DuckDB read alike. A rule keeps its bit for ever; new ones go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 4 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "bullets": "10 * n_bullets > 9 * n_lines",
    "ellipses": "10 * n_ellipses > 3 * n_lines",
    "few_letters": "10 * n_lettered < 5 * n_words",
    "long_word": "longest_word > 1000",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")


def mask(names: Iterable[str]) -> int:
    return sum(BIT[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: any ``hard`` rule rejects, and more than ``allowed`` of the ``soft`` ones."""

    version: str
    hard: tuple[str, ...] = BASE
    soft: tuple[str, ...] = ()
    allowed: int = 0

    def keeps(self, failures: Column, without: Column | int = 0) -> Column:
        """Whether it keeps a row with these failure bits; ``without``: bits that don't count."""
        seen = failures.bitwiseAND(F.bitwise_not(F.lit(without) if isinstance(without, int) else without).cast("long"))
        return (seen.bitwiseAND(F.lit(mask(self.hard))) == 0) & (F.bit_count(seen.bitwiseAND(F.lit(mask(self.soft)))) <= self.allowed)


POLICIES = {
    p.version: p
    for p in (
        Policy("1"),
        Policy("2", hard=(*BASE, "word_length", "few_letters", "long_word"), soft=("symbols", "duplicate_lines", "bullets", "ellipses"), allowed=1),
    )
}
LATEST = "2"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pair = np.unique(a[:-2] * len(number) + a[1:-1], return_inverse=True)
    _, window, count = np.unique(pair * len(number) + a[2:], return_inverse=True, return_counts=True)
    again, covered = count[window] > 1, np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text."""
    words, lines, seen, dup = _WORD.findall(text), 0, set(), 0
    bullets = ellipses = 0
    for line in text.split("\n"):
        if bare := line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
            bullets += bare[0] in "-*•"
            ellipses += bare.endswith(("...", "…"))
    lengths = [len(w) for w in words]
    lettered = sum(1 for w in words if _LETTER.search(w))
    return len(words), sum(lengths), len(_SYMBOL.findall(text)), dup, repeated_words(words), lines, bullets, ellipses, lettered, max(lengths, default=0)


def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def failure_bits() -> Column:
    """All rules at once, as bits of a long, from columns named as MEASURES."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, every measure and ``failures``: each row's text is read once, whole, without
    a shuffle, and written; policies and ablations read the ledger, not the texts.

    Null text: as empty, which has no words and fails few_words alone. Very long texts:
    whole, in time n log n. Ties: none; a rule fails only beyond its bound. Repeated rows
    and null ids: each row by itself. Empty table: empty ledger. Other columns: not read,
    so their names don't matter.
    """
    run = F.pandas_udf(measures, ", ".join(f"{m} long" for m in MEASURES))
    read = docs.select(F.col(id_col).alias("_id"), run(text_of(docs, text_col)).alias("_m")).select("_id", "_m.*")
    return stored(read.withColumn("failures", failure_bits()), "ledger")


def judged(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows with ``base_failed`` and the policy's ``kept``; a row that fails a
    base rule isn't kept under any policy."""
    base = F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & policy.keeps(F.col("failures"))})


def ablation(rows: DataFrame, policies: Iterable[Policy]) -> DataFrame:
    """version, rule, n_rows, n_failed, n_kept, n_kept_without (were the rule not there) and
    n_decisive (rejected because of this rule alone).

    Rows of a ledger are first counted by their bits, at most 2^9 of them whatever the
    table's size; every policy and rule is worked out on those counts. No rows: no result.
    """
    counts = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for policy in policies:
        each = counts.select("failures", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items()])).alias("r"))
        kept = policy.keeps(F.col("failures"))
        without = policy.keeps(F.col("failures"), F.col("r.bit"))
        n = F.col("n")
        part = each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("failures").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(kept, n).otherwise(0)).alias("n_kept"),
            F.sum(F.when(without, n).otherwise(0)).alias("n_kept_without"),
            F.sum(F.when(without & ~kept, n).otherwise(0)).alias("n_decisive"),
        )
        found = part if found is None else found.union(part)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five measures of the contract, base_failed, kept, failures (the bits)."""
    rows = judged(ledger(table(spark, sf_dir, "documents")), POLICIES[LATEST])
    return rows.select(F.col("_id").alias("doc_id"), *MEASURES[:5], "base_failed", "kept", "failures")


def sql(policy: Policy) -> str:
    bits = " + ".join(f"CASE WHEN {failed} THEN {BIT[name]} ELSE 0 END" for name, failed in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
g AS (SELECT rid, pos, {{'a': word, 'b': lead(word) OVER o, 'c': lead(word, 2) OVER o}} AS gram, lead(pos, 2) OVER o IS NOT NULL AS whole
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE whole) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY rid),
words AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, max(length(word)) AS longest_word,
          count(*) FILTER (regexp_matches(word, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')) AS n_lettered FROM w GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM d),
b AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare, row_number() OVER (PARTITION BY rid, line ORDER BY line_no) AS nth FROM l),
lines AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (left(bare, 1) IN ('-', '*', '•')) AS n_bullets,
          count(*) FILTER (bare LIKE '%...' OR bare LIKE '%…') AS n_ellipses FROM b WHERE bare <> '' GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(n_lettered, 0) AS n_lettered, coalesce(longest_word, 0) AS longest_word
      FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask(BASE)} <> 0 AS base_failed,
       failures & {mask((*BASE, *policy.hard))} = 0 AND bit_count(failures & {mask(policy.soft)}) <= {policy.allowed} AS kept, failures
FROM f
"""


SQL = sql(POLICIES[LATEST])
