"""Suffix arrays by induced sorting and permuted longest common prefixes, in numpy.

The induction walks the symbol buckets in order and handles each bucket as arrays: the
predecessors of a block of sorted suffixes are dealt to their buckets by one stable sort.
"""

from __future__ import annotations

import numpy as np

from rampart.llm.textkit import loads8


def _dealt(ch: np.ndarray, k: int):
    """Order of ``ch`` by symbol (stable), the symbols that occur, and their counts."""
    order = np.argsort(ch, kind="stable")
    if len(ch) * 8 < k:  # a short block: no counting over the whole alphabet
        c = ch[order]
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        return order, c[new], np.diff(np.append(new, len(c)))
    cnt = np.bincount(ch, minlength=k)
    sym = np.flatnonzero(cnt)
    return order, sym, cnt[sym]


def _before(t: np.ndarray, k: int, is_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, the symbol before it where that opens a larger (a smaller) suffix, else k."""
    kind = np.uint16 if k < 65536 else np.int32
    out = np.full((2, len(t)), k, kind)
    sym, none = t[:-1].astype(kind), kind(k)
    out[0, 1:] = np.where(is_s[:-1], none, sym)
    out[1, 1:] = np.where(is_s[:-1], sym, none)
    return out[0], out[1]


def _induce(t: np.ndarray, k: int, before: tuple[np.ndarray, np.ndarray], lms: np.ndarray) -> np.ndarray:
    """Sort all suffixes of ``t`` from the order of its leftmost-smaller ones within buckets."""
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int32)
    used = np.flatnonzero(size)
    before_larger, before_smaller = before
    # leftmost-smaller suffixes at the bucket ends, in the given order
    lms_at = end.copy()
    if len(lms):
        order, sym, cnt = _dealt(t[lms], k)
        lms_at[sym] -= cnt
        sa[np.arange(len(lms)) + np.repeat(lms_at[sym] + cnt - np.cumsum(cnt), cnt)] = lms[order]
    head = start.copy()

    def push_larger(block: np.ndarray) -> None:
        ch = before_larger.take(block)
        at = np.flatnonzero(ch != k)
        if len(at) == 1:
            c = ch[at[0]]
            sa[head[c]] = block[at[0]] - 1
            head[c] += 1
        elif len(at):
            order, sym, cnt = _dealt(ch[at], k)
            sa[np.arange(len(at)) + np.repeat(head[sym] + cnt - np.cumsum(cnt), cnt)] = block[at[order]] - 1
            head[sym] += cnt

    first = int(t[n - 1])  # the empty suffix sorts first; its predecessor opens its bucket
    sa[head[first]] = n - 1
    head[first] += 1
    for c in used.tolist():
        cur = start[c]
        while cur < head[c]:
            block, cur = sa[cur:head[c]], head[c]
            push_larger(block)
        if lms_at[c] < end[c]:
            push_larger(sa[lms_at[c]:end[c]])
    tail = end.copy()

    def push_smaller(block: np.ndarray) -> None:
        ch = before_smaller.take(block)
        at = np.flatnonzero(ch != k)
        if len(at) == 1:
            c = ch[at[0]]
            tail[c] -= 1
            sa[tail[c]] = block[at[0]] - 1
        elif len(at):
            order, sym, cnt = _dealt(ch[at], k)
            sa[np.repeat(tail[sym] - 1 + np.cumsum(cnt) - cnt, cnt) - np.arange(len(at))] = block[at[order]] - 1
            tail[sym] -= cnt

    for c in used[::-1].tolist():
        cur = end[c]
        while tail[c] < cur:
            block, cur = sa[tail[c]:cur][::-1], tail[c]
            push_smaller(block)
        if start[c] < head[c]:
            push_smaller(sa[start[c]:head[c]][::-1])
    return sa


def _by_doubling(r: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string by rank doubling over the groups not yet separated."""
    n = len(r)
    both = np.sort((r.astype(np.int64) << 32) | np.arange(n))  # symbols and places are 31-bit numbers
    order, s = both & 0xFFFFFFFF, both >> 32
    new = np.append(True, s[1:] != s[:-1])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    step = 1
    while True:
        single = new & np.append(new[1:], True)
        live = np.flatnonzero(~single)
        if not len(live):
            return order.astype(np.int32)
        idx = order[live]
        nxt = rank[np.minimum(idx + step, n)]
        key = group[live]
        o = np.argsort(key * (n + 1) + nxt)  # below 2^62, as places are 32-bit numbers
        idx, nxt, key = idx[o], nxt[o], key[o]
        order[live] = idx  # groups keep their places, members are refined inside them
        brk = np.append(True, (key[1:] != key[:-1]) | (nxt[1:] != nxt[:-1]))
        new[live] = brk
        group[live] = np.maximum.accumulate(np.where(brk, live, 0))
        rank[idx] = group[live]
        step *= 2


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Suffix array of ``t`` (symbols 0 .. k - 1): classify suffixes, sort the leftmost-smaller
    substrings by induction, name them, order the named string recursively, induce the rest."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    last = np.append(t[1:] != t[:-1], True)  # ends of equal runs
    ends = np.flatnonzero(last)
    up = np.append(t[ends[:-1]] < t[ends[:-1] + 1], False)  # the last suffix is larger than the empty one
    is_s = np.repeat(up, np.diff(np.append(-1, ends)))
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    before = _before(t, k, is_s)
    if not len(lms):
        return _induce(t, k, before, lms)
    sa = _induce(t, k, before, lms)
    by_sub = sa[is_lms[sa]].astype(np.int64)
    m = len(lms)
    length = np.empty(n, np.int32)
    length[lms] = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    a, b = by_sub[:-1], by_sub[1:]
    same = length[a] == length[b]
    same &= (a != lms[-1]) & (b != lms[-1])
    live = np.flatnonzero(same)
    off = 0
    while len(live):
        keep = t[a[live] + off] == t[b[live] + off]
        same[live[~keep]] = False
        off += 1
        live = live[keep]
        live = live[length[a[live]] > off]
    names = np.cumsum(np.append(0, ~same))
    n_names = int(names[-1]) + 1
    if n_names < m:
        named = np.empty(n, np.int32)
        named[by_sub] = names
        r = named[lms]
        if n_names * 64 <= m:  # few symbols: recurse
            order = suffix_array(r.astype(np.uint16 if n_names < 65536 else np.int32), n_names)
        else:
            order = _by_doubling(r)
        by_sub = lms[order]
    return _induce(t, k, before, by_sub)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp[i]: length of the longest common prefix of suffix i and its predecessor in the
    suffix array. Only positions whose left neighbours differ are compared (8 bytes at a
    time); each other value is its left neighbour's less one."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    left = t[sa - 1]
    new = np.ones(n, bool)
    new[1:] = (left[1:] != left[:-1]) | (sa[1:] == 0) | (sa[:-1] == 0)
    rank = np.flatnonzero(new)[1:]  # the first suffix has no predecessor
    x, y = sa[rank].astype(np.int64), sa[rank - 1].astype(np.int64)
    w8 = loads8(t)
    val = np.zeros(len(rank), np.int64)
    live, off = np.arange(len(rank)), 0
    while len(live):
        a, b = x[live] + off, y[live] + off
        lead = np.minimum(_equal_bytes(w8[a] ^ w8[b]), n - np.maximum(a, b))
        val[live] += lead
        live = live[lead == 8]
        off += 8
    # a common prefix never ends before that of the position to the left
    reach = np.zeros(n, np.int64)
    reach[sa[0]] = sa[0]
    reach[x] = val + x
    return np.maximum.accumulate(reach) - np.arange(n)


def _equal_bytes(diff: np.ndarray) -> np.ndarray:
    """Bytes (of 8, little-endian) below the lowest set bit."""
    low = (diff & -diff).astype(np.float64)  # a power of two: its exponent is exact
    return np.where(diff == 0, 8, ((low.view(np.int64) >> 52) - 1023) >> 3)
