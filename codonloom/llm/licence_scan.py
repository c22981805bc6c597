"""Operator 6: licence scan by Dice coefficient over word bigrams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import table, text_of
from codonloom.llm.licence_texts import templates, whole_texts
from codonloom.llm.shingles import BACK, BASE, mix, powers

#: Least Dice coefficient of a match.
DICE = 0.8

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def bigrams_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's words (ASCII letters in lower case, ASCII punctuation as space):
    a hash of each two neighbours, the byte starts and ends of the words, and the
    number of the line or sentence that each word is in."""
    b = np.frombuffer(raw.translate(_NORMAL), np.uint8)
    word = np.concatenate([[False], b != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, starts
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)))])
    w = mix((sums[ends] - sums[starts]) * powers(BACK, len(b))[starts] + (ends - starts).astype(np.uint64))
    o = np.frombuffer(raw, np.uint8)
    space = np.append((o == 32) | ((o >= 9) & (o <= 13)), True)
    stop = (o == 10) | (((o == 46) | (o == 33) | (o == 63) | (o == 59)) & space[1:])
    return mix(w[:-1] * np.uint64(BASE) + w[1:]), starts, ends, np.cumsum(stop)[starts]


class Templates:
    """Bigram sets of templates, the first ``whole`` of them whole licences, and which
    templates each bigram is in."""

    def __init__(self, texts: list[tuple[str, str]], whole: int = 0, dice: float = DICE):
        self.whole = whole
        self.ids = [i for i, _ in texts]
        sets = [np.unique(bigrams_of(t.encode())[0]) for _, t in texts]
        self.sizes = np.array([len(s) for s in sets])
        self.all = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.member = np.zeros((len(self.all), len(sets)), dtype=bool)
        for j, s in enumerate(sets):
            self.member[np.searchsorted(self.all, s), j] = True
        self.dice = dice
        # Dice = 2 common / (m + n) >= d needs d / (2 - d) * m <= common <= n <= (2 - d) / d * m.
        self.least = np.ceil(dice / (2 - dice) * self.sizes - 1e-9)
        self.most = np.floor((2 - dice) / dice * self.sizes + 1e-9)

    def matches(self, raw: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, Dice) of passages of whole lines or sentences, in
        bytes. Of passages that overlap that of a whole licence stays before a notice
        (long licences quote their own), then the more similar, then the longer, then
        the earlier, then that of the earlier template."""
        grams, starts, ends, unit = bigrams_of(raw)
        if not len(grams) or not len(self.all):
            return []
        at = np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)
        hit = self.all[at] == grams
        common = self.member[np.unique(at[hit])].sum(axis=0)
        likely = np.flatnonzero((common >= self.least) & (self.sizes > 0))
        if not len(likely):
            return []
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1)  # where each bigram stood last
        before[order[1:]] = np.where(grams[order[1:]] == grams[order[:-1]], order[:-1], -1)
        found = []
        for j in likely:
            ours = np.zeros(len(grams), dtype=bool)
            ours[hit] = self.member[at[hit], j]
            found += self._passages(int(j), before, unit, ours)
        found.sort(key=lambda f: (f[3] >= self.whole, -f[2], f[0] - f[1], f[0], f[3]))
        out, taken = [], np.zeros(len(starts), dtype=bool)
        for first, last, dice, j in found:
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                out.append((int(starts[first]), int(ends[last]), self.ids[j], dice))
        return sorted(out)

    def _passages(self, j: int, before: np.ndarray, unit: np.ndarray, ours: np.ndarray) -> list[tuple[int, int, float, int]]:
        """The best passage from each line or sentence with a bigram of template j:
        (first word, last word, Dice, j). Passages outside the size bounds are not tried."""
        bounds = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
        begins = np.unique(np.searchsorted(bounds, np.flatnonzero(ours), side="right") - 1)
        total, most, out = np.concatenate([[0], np.cumsum(ours)]), int(self.most[j]), []
        for u in begins.tolist():
            first, wide = int(bounds[u]), 2 * most + 2
            if total[min(len(ours), first + wide)] - total[first] < self.least[j]:
                continue
            while True:  # as far as the distinct bigrams stay within the bound
                new = before[first : first + wide] < first
                seen = np.cumsum(new)
                if first + wide >= len(before) or seen[-1] > most:
                    break
                wide *= 2
            shared = np.cumsum(new & ours[first : first + wide])
            ends = bounds[u + 1 : np.searchsorted(bounds, first + len(seen) + 1, side="right")] - 1 - first
            ends = ends[(ends > 0) & (ends <= len(seen))]
            ends = ends[seen[ends - 1] <= most]
            dice = 2 * shared[ends - 1] / (self.sizes[j] + seen[ends - 1])
            if len(dice) and dice.max() >= self.dice - 1e-12:
                best = int(dice.argmax())
                out.append((first, first + int(ends[best]), float(dice[best]), j))
        return out


@lru_cache(maxsize=1)
def known() -> Templates:
    return Templates(templates(), len(whole_texts()))


def scan_text(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = known().matches(text.encode("utf-8", "surrogatepass"))
        rows.append((
            len(found), ",".join(sorted({f[2] for f in found})), max((round(f[3], 6) for f in found), default=0.0),
            ",".join(f"{i}:{a}:{b}" for a, b, i, _ in found),
        ))
    return pd.DataFrame(rows, columns=["n_matches", "licences", "best_dice", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_matches, licences, best_dice and spans for each row; no shuffle.

    spans: ``licence:start:end``, by start, in bytes of UTF-8, comma-joined. Null
    text: as empty, no match. Repeated rows: each on its own. Very long texts: whole;
    a document is scanned template by template only where enough of a template's
    bigrams occur. Ties: the longer, then the earlier passage, then the first
    template. Empty table: empty result. Other columns: not read, so their names
    don't matter.
    """
    found = F.pandas_udf(scan_text, "n_matches long, licences string, best_dice double, spans string")
    out = docs.select(F.col(id_col).alias("doc_id"), found(text_of(docs, text_col)).alias("r"))
    return out.select("doc_id", "r.n_matches", "r.licences", "r.best_dice", "r.spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
