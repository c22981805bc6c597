"""Operator 8: repeated substrings by suffix arrays built with induced sorting."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonloom.llm.common import fresh, stable, stored, table, text_of, with_row_id
from codonloom.llm.shingles import BACK, BASE, mix, powers
from codonloom.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of a repeat.
LENGTH = 100
#: An anchor is the first of the least-hashed strings of this many bytes in a window of
#: LENGTH bytes, so equal windows have equal anchors at equal offsets.
ANCHOR = 37
STEPS = (1, 2, 4, 8, 16, 32)  # the anchors of a window: LENGTH - ANCHOR + 1 = 64
#: A window holds its anchor and this many bytes before it, or this many after it.
SIDE = 32
BASE2 = 0xD6E8FEB86659FD93
BACK2 = pow(BASE2, -1, 1 << 64)
#: Windows handled at once, rows held before copies are collapsed, bytes of a shard's array.
CHUNK, HELD, SHARD = 1 << 20, 400_000, 1 << 20
#: Different segments of one anchor that a task holds; an anchor with more is split by windows.
KEY_ROWS = 100_000
#: One document in so many is sampled for anchors that stand in many different contexts.
HOT_SAMPLE = 32
#: An anchor is hot if its different contexts in the sample exceed both of these.
HOT_LEAST, HOT_SHARE = 16, 1e-4
#: Bytes of text for each partition of the shuffles, up to so many partitions.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 100_000

ROW = "k long, seg long, wide long, doc long, rid long, a long, n int"
NAMES = ["k", "seg", "wide", "doc", "rid", "a", "n"]
TYPES = [pa.int64()] * 6 + [pa.int32()]


def sums_of(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Running sums of a text's bytes times the powers of both bases, and the powers of their inverses."""
    x, zero, size = b.astype(np.uint64) + np.uint64(1), np.zeros(1, np.uint64), len(b)
    one, two = (np.concatenate([zero, np.cumsum(x * powers(base, size))]) for base in (BASE, BASE2))
    return one, two, powers(BACK, size), powers(BACK2, size)


def window_hashes(one: np.ndarray, two: np.ndarray, back: np.ndarray, back2: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window that starts at one of w."""
    return mix((one[w + LENGTH] - one[w]) * back[w] + np.uint64(LENGTH)), mix((two[w + LENGTH] - two[w]) * back2[w])


def hashed_windows(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, seg, wide, a, n) of all windows of b, each by itself."""
    w = np.arange(len(b) - LENGTH + 1)
    k, seg = window_hashes(*sums_of(b), w)
    return k, seg, np.zeros(len(w), np.uint64), w, np.ones(len(w), np.int32)


def segments(b: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, seg, wide, a, n) of a text of bytes: runs of n windows, the first starting at
    a, that share an anchor, whose hash is k; seg hashes the bytes that the windows
    cover and the anchor's place in them; wide holds 32 bits each of the hashes of the
    anchor with the SIDE bytes before and after it, 0 where no window has those. For a
    hot anchor, k and seg hash each window by itself, with n = 1 and wide = 0."""
    size = len(b)
    one, two, back, back2 = sums_of(b)
    h = mix((one[ANCHOR:] - one[:-ANCHOR]) * back[: size - ANCHOR + 1])
    low, at = h, np.arange(len(h), dtype=np.int32)
    for step in STEPS:  # the first least of twice as many anchors each time
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
    a = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    n = np.diff(np.append(a, len(at)))
    k = low[a]
    end = a + n - 1 + LENGTH
    seg = mix((two[end] - two[a]) * back2[a] + mix((n * 128 + (at[a] - a)).astype(np.uint64)))
    m = at[a].astype(np.int64)
    before = np.where(m - a >= SIDE, mix((one[m + ANCHOR] - one[np.maximum(m - SIDE, 0)]) * back[np.maximum(m - SIDE, 0)]) | np.uint64(1 << 32), np.uint64(0))
    after_end = np.minimum(m + ANCHOR + SIDE, size)
    after = np.where(m + ANCHOR + SIDE <= end, mix((one[after_end] - one[m]) * back[m]) | np.uint64(1 << 32), np.uint64(0))
    wide = ((before >> np.uint64(32)) << np.uint64(32)) | (after >> np.uint64(32))
    if len(hot):
        there = np.isin(k, hot)
        if there.any():
            w = np.concatenate([np.arange(i, i + m) for i, m in zip(a[there], n[there], strict=True)])
            wk, ws = window_hashes(one, two, back, back2, w)
            k, seg, a = np.concatenate([k[~there], wk]), np.concatenate([seg[~there], ws]), np.concatenate([a[~there], w])
            n = np.concatenate([n[~there], np.ones(len(w), dtype=n.dtype)])
            wide = np.concatenate([wide[~there], np.zeros(len(w), np.uint64)])
    return k, seg, wide, a, n


def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, type=t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def collapse(k, seg, wide, doc, rid, a, n):
    """Rows ordered by k, seg and place, and whether each is the first of its (k, seg)."""
    order = np.lexsort((a, rid, doc, seg, k))
    k, seg, wide, doc, rid, a, n = (c[order] for c in (k, seg, wide, doc, rid, a, n))
    first = np.append(True, (k[1:] != k[:-1]) | (seg[1:] != seg[:-1])) if len(k) else np.zeros(0, bool)
    return (k, seg, wide, doc, rid, a, n), first


def merged(rid: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow one another, as one."""
    order = np.lexsort((a, rid))
    rid, a, end = rid[order], a[order], (a + n)[order]
    new = np.append(True, (rid[1:] != rid[:-1]) | (a[1:] > end[:-1])) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rid[at], a[at], (np.maximum.reduceat(end, at) if len(at) else end) - a[at]


def flushed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    cols, first = collapse(*(np.concatenate(c) for c in zip(*held, strict=True)))
    yield batch_of(*(c[first] for c in cols))
    again = ~first
    if again.any():
        rid, a, n = merged(cols[4][again], cols[5][again], cols[6][again])
        zero = np.zeros(len(rid), np.int64)
        yield batch_of(mix(rid.view(np.uint64) + np.uint64(1)), zero, zero, zero, rid, a, -n)


def find_segments(hot: np.ndarray):
    """mapInArrow: (rid, doc, text) -> rows of segments. Of equal segments that a task
    holds at once the first goes on; the others are covered, and go on as rows with
    n < 0 under a key of their own document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        for batch in batches:
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = np.frombuffer(text.as_buffer() or b"", np.uint8)
                for lo in range(0, max(0, len(b) - LENGTH + 1), CHUNK):
                    k, seg, wide, a, n = segments(b[lo : lo + CHUNK + LENGTH - 1], hot)
                    held.append((k, seg, wide, np.full(len(k), doc), np.full(len(k), rid), a.astype(np.int64) + lo, n))
                    count += len(k)
                    if count >= HELD:
                        yield from flushed(held)
                        held, count = [], 0
        if held:
            yield from flushed(held)

    return run


def by_key(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Numpy columns of a stream sorted by its first one; keys are never split."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns))
        if rest is not None:
            cols = tuple(np.concatenate(c) for c in zip(rest, cols, strict=True))
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield tuple(c[:cut] for c in cols)
        rest = tuple(c[cut:] for c in cols)
    if rest is not None and len(rest[0]):
        yield rest


def judged(shard: int, k, seg, wide, doc, rid, a, n) -> Iterator[pa.RecordBatch]:
    """All different segments of some anchors -> those that also agree SIDE bytes further
    on one side with another, as equal windows do. They go on under their anchor; if
    that has more than a shard of them, under the anchor with each side they agree
    on, where equal windows meet as well; if even that has, by windows (wide = 1)."""
    size = n.astype(np.int64) - 1 + LENGTH
    halves = [(k, np.zeros(len(k), bool))] * 2
    for h, half in enumerate((wide.view(np.uint64) >> np.uint64(32), wide.view(np.uint64) & np.uint64(0xFFFFFFFF))):
        key, shared = mix(k.view(np.uint64) ^ (half * np.uint64(BASE)) + np.uint64(h)).view(np.int64), np.zeros(len(k), bool)
        there = np.flatnonzero(half)
        _, inverse, times = np.unique(key[there], return_inverse=True, return_counts=True)
        shared[there[times[inverse] > 1]] = True
        halves[h] = (key, shared)
    some = halves[0][1] | halves[1][1]
    large = over_shard(shard, k, size, some)
    if (some & ~large).any():
        yield batch_of(*(c[some & ~large] for c in (k, seg, np.zeros_like(wide), doc, rid, a, n)))
    if large.any():
        crowded = [over_shard(shard, key, size, shared & large) for key, shared in halves]
        by_window = crowded[0] | crowded[1]
        if by_window.any():
            yield batch_of(*(c[by_window] for c in (k, seg, np.ones_like(wide), doc, rid, a, n)))
        for (key, shared), over in zip(halves, crowded, strict=True):
            on = shared & large & ~over
            if on.any():
                yield batch_of(*(c[on] for c in (key, seg, np.zeros_like(wide), doc, rid, a, n)))


def over_shard(shard: int, key: np.ndarray, size: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of some rows, those whose key has more than ``shard`` bytes of them."""
    out, at = np.zeros(len(key), bool), np.flatnonzero(some)
    _, inverse = np.unique(key[at], return_inverse=True)
    out[at] = (np.bincount(inverse, weights=size[at]) > shard)[inverse] if len(at) else False
    return out


def match_segments(shard: int, key_rows: int):
    """mapInArrow over rows sorted by k, seg and place. Every segment but the first of
    its equals is covered: a row with n < 0. Different segments of an anchor are
    held, up to key_rows, until it ends, and judged; an anchor with more is hot after
    all: its segments go on by windows (wide = 1). All other rows are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last, count, hot = None, 0, None
        for batch in batches:
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            done = cols[6] < 0
            if done.any():
                yield batch_of(*(c[done] for c in cols))
                cols = tuple(c[~done] for c in cols)
            k, seg, rid, a, n = cols[0], cols[1], cols[4], cols[5], cols[6]
            if not len(k):
                continue
            first = np.append(last != (k[0], seg[0]), (k[1:] != k[:-1]) | (seg[1:] != seg[:-1]))
            last = (k[-1], seg[-1])
            again = ~first
            if again.any():
                r, s, m = merged(rid[again], a[again], n[again])
                zero = np.zeros(len(r), np.int64)
                yield batch_of(zero, zero, zero, zero, r, s, -m)
            cols = tuple(c[first] for c in cols)
            if hot is not None:
                more = cols[0] == hot
                if more.any():
                    yield batch_of(*(c[more] for c in (*cols[:2], np.ones_like(cols[2]), *cols[3:])))
                cols = tuple(c[~more] for c in cols)
            if not len(cols[0]):
                continue
            hot, open_from = None, int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if open_from or (held and held[0][0][0] != cols[0][-1]):
                yield from judged(shard, *(np.concatenate(c) for c in zip(*held, tuple(c[:open_from] for c in cols), strict=True)))
                held, count = [], 0
            held.append(tuple(c[open_from:] for c in cols))
            count += len(cols[0]) - open_from
            if count > key_rows:
                hot = held[0][0][0]
                yield from (batch_of(*h[:2], np.ones_like(h[2]), *h[3:]) for h in held)
                held, count = [], 0
        if held:
            yield from judged(shard, *(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def lists_of(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a column of lists of structs; a null list is empty."""
    return column.offsets.to_numpy(), [f.to_numpy() for f in column.values.flatten()]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (rid, text, wanted) -> (k, doc, rid, a, b), the bytes of the segments
    asked of each text, in batches of about SHARD bytes."""
    names, types = ["k", "doc", "rid", "a", "b"], [pa.int64()] * 4 + [pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        at, (k, doc, a, n) = lists_of(batch.column(2))
        rows, size = [], 0
        for i, rid in enumerate(batch.column(0).to_pylist()):
            text = batch.column(1)[i].as_buffer()
            for j in range(at[i], at[i + 1]):
                piece = text.slice(int(a[j]), int(n[j]) - 1 + LENGTH).to_pybytes()
                rows.append((int(k[j]), int(doc[j]), rid, int(a[j]), piece))
                size += len(piece)
            if size >= SHARD:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def windows_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (rid, text, wanted) -> rows of segments of one window each, for all
    windows of the segments asked of each text. Of equal ones that a task holds at
    once the first goes on; the others are covered."""
    for batch in batches:
        at, (_, doc, start, count) = lists_of(batch.column(2))
        held: list[tuple[np.ndarray, ...]] = []
        for i, rid in enumerate(batch.column(0).to_pylist()):
            b = np.frombuffer(batch.column(1)[i].as_buffer() or b"", np.uint8)
            for j in range(at[i], at[i + 1]):
                k, seg, wide, a, n = hashed_windows(b[start[j] : start[j] + count[j] - 1 + LENGTH])
                held.append((k, seg, wide, np.full(len(k), doc[j]), np.full(len(k), rid), a + start[j], n))
                if sum(len(h[0]) for h in held[-64:]) >= HELD or len(held) >= 4096:
                    yield from flushed(held)
                    held = []
        if held:
            yield from flushed(held)


def cover_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (k, doc, rid, a, b) sorted by k: the suffix array of each shard
    of about SHARD bytes, whole keys together. Where neighbours in the array share
    LENGTH bytes their windows are equal; all but the first in place are covered."""

    def covered(doc: np.ndarray, rid: np.ndarray, a: np.ndarray, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        # 0 ends the string, 1 stands between segments; a window never reaches past its segment.
        t = np.frombuffer(b"\x00".join(parts), np.uint8).astype(np.int64) + 2
        t[starts[1:] - 1] = 1
        t = np.append(t, 0)
        sa = suffix_array(t)
        plcp = permuted_prefixes(t, sa, LENGTH)
        owner = np.searchsorted(starts, sa, side="right") - 1
        offset = sa - starts[owner]
        group = np.cumsum(plcp[sa] < LENGTH)
        ok = offset <= sizes[owner] - LENGTH
        owner, offset, group = owner[ok], offset[ok], group[ok]
        at = a[owner] + offset
        order = np.lexsort((at, rid[owner], doc[owner], group))
        owner, at, group = owner[order], at[order], group[order]
        again = np.append(False, group[1:] == group[:-1])
        r, s, m = merged(rid[owner[again]], at[again], np.ones(int(again.sum()), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(m)], names=["rid", "a", "n"])

    held: list[tuple] = []
    size = 0
    for k, doc, rid, a, b in by_key(batches, 5):
        # A key may meet one segment from several texts only by way of the rows above,
        # which keep one of each; so all segments of a key differ.
        held.append((doc, rid, a, list(b)))
        size += sum(map(len, b))
        if size >= SHARD:
            yield from covered(*(np.concatenate(c) for c in list(zip(*held, strict=True))[:3]), [p for h in held for p in h[3]])
            held, size = [], 0
    if held:
        yield from covered(*(np.concatenate(c) for c in list(zip(*held, strict=True))[:3]), [p for h in held for p in h[3]])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, text, runs) -> digest of each text without the bytes that its
    runs of windows cover."""
    for batch in batches:
        at, (starts, counts) = lists_of(batch.column(2))
        rows = []
        for i in range(batch.num_rows):
            b = memoryview(batch.column(1)[i].as_buffer() or b"")
            lo = starts[at[i] : at[i + 1]]
            hi = (lo + counts[at[i] : at[i + 1]] - 1 + LENGTH)[np.argsort(lo, kind="stable")]
            lo = np.sort(lo)
            # Runs of bytes: a new one begins beyond all that ended before.
            far = np.maximum.accumulate(hi)
            new = np.flatnonzero(np.append(True, lo[1:] > far[:-1])) if len(lo) else np.zeros(0, np.int64)
            first, last = lo[new], far[np.append(new[1:], len(lo)) - 1] if len(lo) else lo
            kept, end = hashlib.sha256(), 0
            for x, y in zip(first.tolist(), last.tolist(), strict=True):
                kept.update(b[end:x])
                end = y
            kept.update(b[end:])
            rows.append((len(b), int((last - first).sum()), len(first), kept.hexdigest()))
        cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)] if rows else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def hot_anchors(source: DataFrame, documents: int) -> np.ndarray:
    """Hashes of anchors that stand in very many different segments, from a sample.
    They are routed by whole windows instead; which are found changes no result. An
    anchor counts only above a share of the sampled documents, so they are bounded
    by the anchors of a document times 1 / HOT_SHARE."""
    sample = source.filter(F.pmod(F.xxhash64("rid"), F.lit(HOT_SAMPLE)) == 0)
    least = max(HOT_LEAST, documents / HOT_SAMPLE * HOT_SHARE)
    rows = sample.mapInArrow(find_segments(np.zeros(0, np.uint64)), ROW).filter("n > 0")
    hot = rows.select("k", "seg").distinct().groupBy("k").count().filter(F.col("count") >= least).select("k").collect()
    return np.sort(np.array([r["k"] for r in hot], dtype=np.int64)).view(np.uint64)


def covered_runs(source: DataFrame, shard: int, key_rows: int) -> tuple[DataFrame, int]:
    """(rid, a, n): the windows a .. a + n - 1 of row rid also start earlier; and the
    number of partitions that the size of the texts asks for."""
    documents, size = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    partitions = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(size / PARTITION_BYTES), MOST_PARTITIONS))

    def met_under_key(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "k").sortWithinPartitions("k", "seg", "doc", "rid", "a").mapInArrow(match_segments(shard, key_rows), ROW)

    def with_texts(rows: DataFrame) -> DataFrame:
        asked = stored(rows.repartition(partitions, "rid").groupBy("rid").agg(F.collect_list(F.struct("k", "doc", "a", F.col("n").cast("long").alias("n"))).alias("wanted")), "asked")
        return source.select("rid", "text").repartition(partitions, "rid").join(asked.hint("merge"), "rid").select("rid", "text", "wanted")

    def runs_of(rows: DataFrame) -> DataFrame:
        return rows.filter("n < 0").select("rid", "a", (-F.col("n")).cast("long").alias("n"))

    met = stored(met_under_key(source.mapInArrow(find_segments(hot_anchors(source, documents)), ROW)), "segments")
    parts = with_texts(met.filter("n > 0 AND wide = 0")).mapInArrow(slices, "k long, doc long, rid long, a long, b binary")
    more = parts.repartition(partitions, "k").sortWithinPartitions("k").mapInArrow(cover_shards, "rid long, a long, n long")
    runs = runs_of(met).unionByName(more)
    crowded = met.filter("n > 0 AND wide = 1")
    if not crowded.isEmpty():  # anchors with too many segments for a shard
        runs = runs.unionByName(runs_of(met_under_key(with_texts(crowded).mapInArrow(windows_asked, ROW))))
    return runs, partitions


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, key_rows: int = KEY_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs.

    A window is LENGTH bytes of one text. Every window is filed under its anchor,
    a content-defined place, so equal windows meet; the windows of one anchor and
    text are a segment. Equal segments (by 128 bits of hash, length and anchor's
    place) are collapsed, in the tasks that read the texts and again where they
    meet, so a group of copies of any size sends one row a task. Segments of one
    anchor that differ are joined to shards of about 1 MB; induced sorting gives each
    shard's suffix array, the permuted common prefixes tell equal windows, and all
    but the first are covered. No key grows with the input: an anchor that a sample
    finds in many contexts is never a key, its windows are filed by their own 128
    hash bits; one with more segments than a shard holds is split by the bytes
    beside it, and where those are too common too, by windows.

    Order: smaller id, then the row's number (repeated ids), then the start. A null id
    is after all others. Null text: as empty; texts below LENGTH bytes have no
    windows. Very long texts: whole, a chunk at a time. Ties and repeated rows: the
    row of the smallest number stays whole. Empty table: empty result. Other
    columns: not read, so their names don't matter.
    """
    docs = stable(docs)
    last, row = F.lit((1 << 63) - 1), fresh(docs, "_rid")
    numbered = with_row_id(docs, row).select(F.col(row).alias("rid"), F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    runs, partitions = covered_runs(numbered.select("rid", F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), "text"), shard, key_rows)
    listed = runs.repartition(partitions, "rid").groupBy("rid").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = numbered.repartition(partitions, "rid").join(listed.hint("merge"), "rid", "left")
    return whole.select("doc_id", "text", "runs").mapInArrow(cut_out, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
