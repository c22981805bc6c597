"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The first level, over bytes, runs bucket by bucket on numpy arrays: all suffixes
of a bucket that are known induce their predecessors at once. The recursion, over
names of substrings, is plain Python on a string of at most half the length.
"""

from __future__ import annotations

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next one. t ends in a unique least sentinel."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    s[-1] = True
    step = np.sign(np.diff(t.astype(np.int64)))
    # In a run of equal characters the type is that of the run's end.
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    s[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return s


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from the order of the leftmost S-type ones."""
    n = len(t)
    sa = np.full(n, -1, dtype=np.int64)
    chars = [int(c) for c in np.flatnonzero(ends > starts)]
    # Leftmost S-type suffixes at the ends of their buckets, in the given order.
    order = np.argsort(t[lms], kind="stable")
    own, c = lms[order], t[lms][order]
    last = ends - np.bincount(c, minlength=len(ends))
    rank = np.arange(len(own)) - np.searchsorted(c, c, side="left")
    sa[last[c] + rank] = own
    head = starts.copy()

    def spread(batch: np.ndarray, keep_s: bool) -> tuple[np.ndarray, np.ndarray]:
        j = batch[batch > 0] - 1
        j = j[s[j] == keep_s]
        return j, t[j]

    for b in chars:  # L-type, left to right
        at = int(starts[b])
        while at < head[b]:
            to = int(head[b])
            j, c = spread(sa[at:to], False)
            fill(sa, head, j, c, 1)
            at = to
        tail = sa[max(int(head[b]), int(last[b])) : ends[b]]
        j, c = spread(tail[tail >= 0], False)
        fill(sa, head, j, c, 1)
    back = ends.copy()
    for b in reversed(chars):  # S-type, right to left; they replace what stood at the ends
        at = int(ends[b])
        while at > back[b]:
            to = int(back[b])
            j, c = spread(sa[to:at][::-1], True)
            fill(sa, back, j, c, -1)
            at = to
        j, c = spread(sa[starts[b] : head[b]][::-1], True)
        fill(sa, back, j, c, -1)
    sa[0] = n - 1
    return sa


def fill(sa: np.ndarray, at: np.ndarray, j: np.ndarray, c: np.ndarray, way: int) -> None:
    """Append the suffixes j to the buckets c, in order, forwards or backwards."""
    if not len(j):
        return
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    count = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, count)
    sa[at[c] + rank if way > 0 else at[c] - 1 - rank] = j
    at[c[first]] += way * count


def names_of(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The name of each leftmost S-type substring, by rank; equal substrings share one."""
    n = len(t)
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[k < length[a[live]]]
        equal = t[np.minimum(a[live] + k, n - 1)] == t[np.minimum(b[live] + k, n - 1)]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    out = np.empty(n, dtype=np.int64)
    out[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return out[lms]


def sort_names(t: list[int], k: int) -> list[int]:
    """Induced sorting of a list of integers below k, with a unique least last one."""
    n = len(t)
    if n == 1:
        return [0]
    s = [False] * n
    s[-1] = True
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    size = [0] * (k + 1)
    for c in t:
        size[c + 1] += 1
    for c in range(k):
        size[c + 1] += size[c]
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]

    def induced(first: list[int]) -> list[int]:
        sa, end = [-1] * n, size[1:]
        for i in reversed(first):
            end[t[i]] -= 1
            sa[end[t[i]]] = i
        head = size[:-1]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not s[j]:
                c = t[j]
                sa[head[c]] = j
                head[c] += 1
        end = size[1:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and s[j]:
                c = t[j]
                end[c] -= 1
                sa[end[c]] = j
        return sa

    leftmost = bytearray(n)
    for i in lms:
        leftmost[i] = 1
    ordered = [i for i in induced(lms) if i >= 0 and leftmost[i]]
    until = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    name, names, before = -1, {}, None
    for i in ordered:
        here = t[i : until[i] + 1]
        name += here != before
        names[i], before = name, here
    if name + 1 < len(lms):
        ordered = [lms[i] for i in sort_names([names[i] for i in lms], name + 1)]
    return induced(ordered)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, small integers whose last is the unique least."""
    if len(t) < 2:
        return np.arange(len(t))
    s = suffix_types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    size = np.bincount(t)
    ends = np.cumsum(size)
    starts = ends - size
    sa = induce(t, s, lms, starts, ends)
    leftmost = np.zeros(len(t), dtype=bool)
    leftmost[lms] = True
    ordered = sa[leftmost[sa]]
    names = names_of(t, lms, ordered)
    if len(lms) > 1 and names.max() + 1 < len(lms):
        ordered = lms[np.array(sort_names(names.tolist(), int(names.max()) + 1))]
        sa = induce(t, s, ordered, starts, ends)
    else:
        sa = induce(t, s, ordered, starts, ends)
    return sa


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length of the prefix that its suffix shares with the
    suffix before it in the array, in text order, up to ``most``."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, dtype=np.int64)
    # Characters past the end are all different: a suffix shares nothing beyond itself.
    padded = np.concatenate([t, np.arange(-1, -most - 5, -1)]).astype(np.int64)
    words = np.zeros(len(padded) - 3, dtype=np.int64)
    for k in range(4):  # four characters a word
        words = (words << 16) | (padded[k : k + len(words)] & 0xFFFF)
    live, k = np.flatnonzero(phi >= 0), 0
    while k < most and len(live):
        equal = (words[live + k] == words[phi[live] + k]) & (k + 4 <= most)
        last = live[~equal]
        for j in range(k, min(k + 4, most)):
            last = last[padded[last + j] == padded[phi[last] + j]]
            plcp[last] = j + 1
        live, k = live[equal], k + 4
        plcp[live] = k
    return plcp
