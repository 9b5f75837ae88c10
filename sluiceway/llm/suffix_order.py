"""Suffix order by induced sorting, on numpy arrays.

Suffixes are classified as larger (L) or smaller (S) than their successor.  The
leftmost S suffixes (LMS) are sorted: first their substrings by induction, then,
where substrings are equal, by doubling of their names.  All other suffixes
follow by induction, bucket by bucket, each bucket's suffixes at once as a
vector.  The work is linear but for the doubling, which ends at `depth` bytes:
two suffixes equal that far may stand in either order.
"""

from __future__ import annotations

import numpy as np


def _spread(parts: list[list[np.ndarray]], j: np.ndarray, t: np.ndarray) -> None:
    """Append suffixes j, in their order, to the buckets of their first bytes."""
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    begin = 0
    for end in [*cuts.tolist(), len(j)]:
        parts[c[begin]].append(j[begin:end])
        begin = end


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix order that the order of the LMS suffixes implies."""
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _spread(seeds, lms, t)
    larger[t[-1]].append(np.array([len(t) - 1], np.int32))
    for c in range(256):
        done, front = [], _joined(larger[c])
        while len(front):
            done.append(front)
            j = front - 1
            j = j[j >= 0]
            j = j[~small[j]]
            same = t[j] == c
            _spread(larger, j[~same], t)
            front = j[same]
        larger[c] = [_joined(done)]
        if seeds[c]:
            _spread(larger, _joined(seeds[c]) - 1, t)
    for c in range(255, -1, -1):
        done, front = [], _joined(smaller[c])
        while len(front):
            done.append(front)
            j = front - 1
            j = j[j >= 0]
            j = j[small[j]]
            same = t[j] == c
            _spread(smaller, j[~same], t)
            front = j[same]
        smaller[c] = [_joined(done)]
        j = larger[c][0][::-1] - 1
        j = j[j >= 0]
        _spread(smaller, j[small[j]], t)
    return np.concatenate([x for c in range(256) for x in (larger[c][0], smaller[c][0][::-1])])


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For each LMS suffix in text order: how many LMS substrings are smaller than its own."""
    n, m = len(t), len(lms)
    place = np.zeros(n, np.int32)
    place[lms] = np.arange(m, dtype=np.int32)
    end = np.append(lms[1:], n).astype(np.int64)
    length = (end - lms)[place[ordered]]
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    new = np.ones(m, bool)
    alike = np.flatnonzero((length[1:] == length[:-1]) & (b + length[1:] < n) & (a + length[1:] < n))
    for begin in range(0, len(alike), 1 << 16):
        k = alike[begin : begin + (1 << 16)]
        size = length[k + 1] + 1
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        same = t[np.repeat(a[k], size) + step] == t[np.repeat(b[k], size) + step]
        new[k + 1] = ~np.logical_and.reduceat(same, first)
    start = np.flatnonzero(new)
    rank = np.repeat(start, np.diff(np.append(start, m)))
    out = np.zeros(m, np.int64)
    out[place[ordered]] = rank
    return out


def _doubled(rank: np.ndarray, depth: int) -> np.ndarray:
    """Refine ranks of a sequence of names until all differ or `depth` bytes are compared."""
    m, step = len(rank), 1
    while 2 * step < 2 * depth:
        tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        if not len(tied):
            break
        after = np.zeros(len(tied), np.int64)
        inner = tied + step < m
        after[inner] = rank[tied[inner] + step] + 1
        key = rank[tied] * (m + 1) + after
        order = np.argsort(key, kind="stable")
        key, group = key[order], rank[tied][order]
        k = np.arange(len(key))
        new_group, new_key = np.ones(len(key), bool), np.ones(len(key), bool)
        new_group[1:], new_key[1:] = group[1:] != group[:-1], key[1:] != key[:-1]
        rank = rank.copy()
        rank[tied[order]] = group + np.maximum.accumulate(np.where(new_key, k, 0)) - np.maximum.accumulate(np.where(new_group, k, 0))
        step *= 2
    return rank


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of t's suffixes, in the order of their first `depth` bytes."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(np.diff(t.astype(np.int16)))
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = rise[at] > 0
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = _induce(t, small, lms)
        ranks = _doubled(_names(t, lms, order[is_lms[order]]), depth)
        lms = lms[np.argsort(ranks, kind="stable")]
    return _induce(t, small, lms)


def common_prefixes(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix of `order` but the first: bytes shared with the one before it, in that order.

    Found in text order (permuted): where the preceding bytes of a pair are equal
    and the preceding pair stands in the table too, the value is the preceding
    one less 1, so only the other, irreducible pairs are compared.  Values of
    `cap` and more are only known to be that large.
    """
    a, b = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    text = np.argsort(a, kind="stable")
    a, b = a[text], b[text]
    chained = np.zeros(len(a), bool)
    if len(a) > 1:
        chained[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
        chained[chained] = t[a[chained] - 1] == t[b[chained] - 1]
    head = np.flatnonzero(~chained)
    follow = np.diff(np.append(head, len(a)))
    want = follow - 1 + cap
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    eights = np.ndarray((len(t) + 8,), "<u8", padded, strides=(1,))
    long = np.zeros(len(head), np.int64)
    room = len(t) - np.maximum(a[head], b[head])
    active = np.arange(len(head))
    while len(active):
        x = eights[a[head[active]] + long[active]] ^ eights[b[head[active]] + long[active]]
        full = x == 0
        part = active[~full]
        y = x[~full]
        low = y & (~y + np.uint64(1))
        long[part] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        active = active[full]
        long[active] += 8
        active = active[(long[active] < want[active]) & (long[active] < room[active])]
    long = np.minimum(long, room)
    out = np.zeros(len(a), np.int64)
    out[text] = np.maximum(np.repeat(long, follow) - (np.arange(len(a)) - np.repeat(head, follow)), 0)
    return out
