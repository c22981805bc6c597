"""Operator 2: best-fit packing by length patterns and non-negative least squares."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.llm.common import cut, table

CAPACITY = 2048
#: Rounds of fitting and rounding before the rest is packed by best fit.
ROUNDS = 3
#: Share of the fitted repeats that a round places: what is left keeps short pieces to fill up with.
SHARE = 0.6
STEPS = 150
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids of a text under a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary runs in tiktoken, which gives the same ids about four times
    as fast; a text that holds one of the file's added tokens goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.full = path, None

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what is over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"


def cut_documents(path: str, capacity: int, with_ids: bool):
    """A mapInArrow function of (doc_id, text). Each piece also gets its rank among
    the pieces of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = encoder(path), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.array([END_ID], dtype="<u4"))
                for piece, (start, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + n]
                    row = (doc.as_py(), piece, start, n, zlib.crc32(own.astype("<u4").tobytes()), task, int(seen[n]))
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    seen[n] += 1
                    held += n
                if len(rows) >= 20_000 or (with_ids and held >= 1_000_000):
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return run


def patterns_of(h: np.ndarray) -> np.ndarray:
    """All patterns of two or three lengths (a >= b >= c, c may be 0) that occur in
    the histogram and fill a sequence exactly: at most capacity^2 / 12 of them."""
    cap = len(h) - 1
    there = np.flatnonzero(h[1:cap]) + 1
    ok = np.zeros(cap + 1, dtype=bool)
    ok[there] = ok[0] = True
    found = []
    for a in there[::-1]:
        b = there[(there <= a) & (there >= (cap - a + 1) // 2) & (there <= cap - a)]
        c = cap - a - b
        keep = ok[c] & (c <= b)
        if keep.any():
            found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_counts(h: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares: the repeats x of the patterns with sum over
    patterns of x * lengths closest to the histogram, by multiplicative updates
    x <- x * (A'h) / (A'Ax), which keep x non-negative."""
    want = h.astype(float).copy()
    want[0] = 0.0

    def back(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        v[0] = 0.0
        return v[patterns].sum(axis=1)

    aim = back(want)
    x = aim / max(aim.sum(), 1e-300) * want.sum() / 3
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=len(h))
        x *= aim / np.maximum(back(made), 1e-12)
    return x


def pack_lengths(h: np.ndarray, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """A packing of the histogram h (h[n] pieces of length n, up to the capacity):
    (pattern as (length, times) pairs, repeats). Work and size depend on the
    capacity, not on how many pieces there are."""
    cap, left = len(h) - 1, h.astype(np.int64).copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if left[cap]:
        plan.append(([(cap, 1)], int(left[cap])))
        left[cap] = 0
    for _ in range(rounds):
        patterns = patterns_of(left)
        if not len(patterns):
            break
        x = fit_counts(left, patterns) * SHARE
        # Rounding with the error carried along the patterns of a length keeps its sum.
        total = np.floor(np.cumsum(x) + 0.5)
        repeats = np.diff(total, prepend=0.0).astype(np.int64)
        done = False
        for i in np.flatnonzero(repeats > 0):
            lengths = [int(n) for n in patterns[i] if n]
            need = {n: lengths.count(n) for n in lengths}
            k = min(int(repeats[i]), *(int(left[n]) // t for n, t in need.items()))
            if k > 0:
                done = True
                for n, t in need.items():
                    left[n] -= k * t
                plan.append((sorted(need.items(), reverse=True), k))
        if not done:
            break
    # The rest: best fit, longest first, on groups of like sequences.
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    free: list[int] = []

    def put(pattern: list[tuple[int, int]], k: int) -> None:
        r = cap - sum(n * t for n, t in pattern)
        if r not in room:
            room[r] = []
            insort(free, r)
        room[r].append((pattern, k))

    for n in range(cap - 1, 0, -1):
        c = int(left[n])
        while c:
            at = bisect_left(free, n)
            if at == len(free):
                q = min(cap // n, c)
                k = c // q
                put([(n, q)], k)
                c -= k * q
                continue
            r = free[at]
            pattern, k = room[r].pop()
            if not room[r]:
                del room[r]
                free.pop(at)
            q = min(r // n, c)  # as many as fit: the fullest sequence stays the best fit
            m = min(k, c // q)
            if k > m:
                room.setdefault(r, []).append((pattern, k - m))
                if r not in free:
                    insort(free, r)
            put([*pattern, (n, q)], m)
            c -= m * q
    return plan + [g for groups in room.values() for g in groups]


def slots_of(plan: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of places by length: the pieces of a length, by rank, fill its runs in
    turn. Piece g of a run with ``times`` places a sequence goes to sequence
    base + g // times, at offset + (g % times) * length."""
    runs, at, sequences = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, k in plan:
        offset = 0
        for n, times in pattern:
            runs.append((n, at[n], times, sequences, offset))
            at[n] += k * times
            offset += n * times
        sequences += k
    runs.sort()
    cols = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "base", "offset"), cols, strict=True))


def placed(slots: dict[str, np.ndarray]):
    keys = slots["length"] * (1 << 48) + slots["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, g = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = np.searchsorted(keys, n * (1 << 48) + g, side="right") - 1
        g = g - slots["first"][run]
        t = slots["times"][run]
        return pd.DataFrame({"sequence_id": slots["base"][run] + g // t, "offset": slots["offset"][run] + g % t * n})

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most
    ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids, with with_ids).

    Texts are tokenised where they lie. The driver gets the histogram of lengths
    (capacity rows), plans patterns, and each piece finds its place from its rank
    among the pieces of its length: its rank in its task plus the counts of the
    tasks before. Only those counts, a row a task and length, are shuffled and
    summed, so a length that a third of all pieces have is no hot key.

    Null text: as empty, one token (the end id). Repeated rows: each on its own.
    Ties between pieces of one length: by task and place in it. Empty table: empty.
    """
    path = path or default_tokenizer()
    schema = PIECE + ", ids array<int>" * with_ids
    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_documents(path, capacity, with_ids), schema))
    counts = pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    h = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most capacity rows
        h[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_task", "length", "_before")
    ranked = pieces.join(offsets, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    place = placed(slots_of(pack_lengths(h), capacity))
    out = ranked.withColumn("_at", place("length", "_rank"))
    ids = ["ids"] * with_ids
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"), *ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
