"""Adaptive context-mixing range coder for token ids, vectorised over interleaved lanes.

A block's ids are dealt to lanes (contiguous stretches). One row codes the next id of every
lane; all lanes share one model, which learns from a row after it is coded, so the decoder can
follow. Three predictions are mixed into one distribution:

* order 2: the id last confirmed after the two ids before it (hashed table),
* order 1: the id last confirmed after the id before it,
* order 0: id counts of the block so far, refreshed at geometric intervals.

The weight of a predicted id is the hit rate seen so far at its confidence; order 0 has the
rest. All arithmetic is on integers, so a block decodes alike everywhere. The model is reset
for every block.
"""

from __future__ import annotations

import numpy as np

_SCALE = 24  # bits of the mixed distribution
_BITS0 = 20  # bits of the order-0 distribution; as many slots at least are left to order 0
_HASH_BITS = 18
_U = np.uint64
_LOW32, _32, _S = _U((1 << 32) - 1), _U(32), _U(_SCALE)


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: a power of two up to 4096, about 256 ids each at least."""
    return 1 << min(12, (n // 256).bit_length() - 1) if n >= 256 else 1


class _Model:
    """Tables hold ``id * 16 + confidence``."""

    def __init__(self, vocab: int, lanes: int):
        self.v = vocab
        self.counts = np.zeros(vocab, np.int64)
        self.seen = self.fresh_n = 0
        self.fresh: list[np.ndarray] = []
        self.t2 = np.zeros(1 << _HASH_BITS, np.int32)
        self.t1 = np.zeros(vocab, np.int32)
        self.rate2 = np.zeros(32, np.int64)  # misses and hits by confidence
        self.rate1 = np.zeros(33, np.int64)
        self.c1 = np.zeros(lanes, np.int64)
        self.c2 = np.zeros(lanes, np.int64)
        self._refresh()

    def _refresh(self) -> None:
        """Order-0 slots: counts scaled by how often ids were new, the rest spread evenly."""
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.v)
        self.seen += self.fresh_n
        self.fresh, self.fresh_n = [], 0
        room = (1 << _BITS0) - self.v
        given = room * self.seen // (self.seen + int(np.count_nonzero(self.counts)) + 1)
        f = self.counts * given // max(self.seen, 1) + max(1, ((1 << _BITS0) - given) // self.v)
        f[np.argmax(f)] += (1 << _BITS0) - int(f.sum())
        self.cum = np.append(0, np.cumsum(f)).astype(np.int32)
        self.slot = None

    def symbols(self) -> np.ndarray:
        """Order-0 slot -> id, for decoding."""
        if self.slot is None:
            kind = np.uint16 if self.v <= 1 << 16 else np.uint32  # small enough to stay in a core's cache
            self.slot = np.repeat(np.arange(self.v, dtype=kind), np.diff(self.cum))
        return self.slot

    def predict(self):
        """Slots of order 2 and of orders 2 and 1 together, and of order 0, for this row."""
        self.h = ((self.c1 * 0x9E3779B1 + self.c2 * 0x85EBCA77) >> 7) & ((1 << _HASH_BITS) - 1)
        self.e2, self.e1 = self.t2[self.h], self.t1[self.c1]
        self.p2, self.p1 = self.e2 >> 4, self.e1 >> 4
        self.k2, self.k1 = self.e2 & 15, self.e1 & 15
        q2, q1 = (np.clip(((2 * r[1:32:2] + 1) << 16) // (2 * (r[0:32:2] + r[1:32:2]) + 2), 16, 49152) for r in (self.rate2, self.rate1))
        w2 = (q2 << (_SCALE - 16))[self.k2]
        rest = (1 << _SCALE) - w2
        w1 = (rest * q1[self.k1]) >> 16
        w1 *= self.p1 != self.p2
        return w2, w2 + w1, rest - w1

    def span(self, s, w2, w12, w0):
        """Start and size of the slots of ids ``s``."""
        self.hit2, self.hit1 = s == self.p2, s == self.p1
        a = (w0 * self.cum[s]) >> _BITS0
        start, size = w12 + a, ((w0 * self.cum[s + 1]) >> _BITS0) - a
        at = np.flatnonzero(self.hit1)
        start[at], size[at] = w2[at], w12[at] - w2[at]
        at = np.flatnonzero(self.hit2)
        start[at], size[at] = 0, w2[at]
        return start.view(np.uint64), size.view(np.uint64)

    def update(self, x: np.ndarray) -> None:
        self.rate2 += np.bincount(2 * self.k2 + self.hit2, minlength=32)
        self.rate1 += np.bincount(np.where(self.hit2, 32, 2 * self.k1 + self.hit1), minlength=33)
        # a confirmed prediction gains confidence, a missed one halves it and is replaced at 0
        for table, at, e, k, hit in ((self.t2, self.h, self.e2, self.k2, self.hit2), (self.t1, self.c1, self.e1, self.k1, self.hit1)):
            table[at] = np.where(hit, e + (k < 15), np.where(k > 1, e - ((k + 1) >> 1), x << 4))
        self.c2, self.c1 = self.c1, x
        self.fresh.append(x)
        self.fresh_n += len(x)
        if self.fresh_n * 8 >= self.seen + 8192:
            self._refresh()


def _cut(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """A range below 2^32 made to end where the leading word would change."""
    apart = ((low ^ (low + rng - _U(1))) >> _32) != 0
    return np.where(apart, (_U(0) - low) & _LOW32, rng)


def encode_block(ids: np.ndarray, vocab: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words of all lanes end to end, words per lane)."""
    n = len(ids)
    rows = -(-n // lanes)
    x = np.zeros(rows * lanes, np.int64)
    x[:n] = ids
    by_row = np.ascontiguousarray(x.reshape(lanes, rows).T)
    m = _Model(vocab, lanes)
    low = np.zeros(lanes, np.uint64)
    rng = np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, rows + 2), np.uint32)
    at = np.zeros(lanes, np.int64)
    for t in range(rows):
        s = by_row[t]
        start, size = m.span(s, *m.predict())
        rng >>= _S
        low += start * rng
        rng *= size
        live = np.flatnonzero(rng <= _LOW32)
        if len(live):  # at most one word a row: an id takes at most 24 of the 32 bits left
            lo = low[live]
            ra = _cut(lo, rng[live])
            words[live, at[live]] = lo >> _32
            at[live] += 1
            low[live], rng[live] = lo << _32, ra << _32
        m.update(s)
    # one more word names a point inside the last range; the decoder reads zeros after it
    if rows:
        words[np.arange(lanes), at] = (low >> _32) + ((low & _LOW32) != 0)
        at += 1
    return words[np.arange(words.shape[1]) < at[:, None]], at


def decode_block(words: np.ndarray, per_lane: np.ndarray, n: int, vocab: int) -> np.ndarray:
    """The n ids that ``encode_block`` was given."""
    lanes = len(per_lane)
    rows = -(-n // lanes)
    m = _Model(vocab, lanes)
    end = np.cumsum(per_lane)
    at = end - per_lane
    src = np.append(words, np.zeros(2, np.uint32)).astype(np.uint64)
    second = np.where(per_lane > 1, src[np.minimum(at + 1, len(words))], 0).astype(np.uint64)
    code = (src[at] << _32) | second
    at = at + 2
    low = np.zeros(lanes, np.uint64)
    rng = np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.empty((rows, lanes), np.int64)
    last = (1 << _SCALE) - 1
    for t in range(rows):
        w2, w12, w0 = m.predict()
        rng >>= _S
        v = np.minimum(((code - low) // rng).astype(np.int64), last)
        u = np.maximum(v - w12, 0)
        # below 2^45 over below 2^24: the floating quotient never reaches the next integer
        slot = ((((u + 1) << _BITS0) - 1) / w0).astype(np.int64)
        s = m.symbols()[np.minimum(slot, (1 << _BITS0) - 1)]
        s = np.where(v < w2, m.p2, np.where(v < w12, m.p1, s)).astype(np.int64)
        out[t] = s
        start, size = m.span(s, w2, w12, w0)
        low += start * rng
        rng *= size
        live = np.flatnonzero(rng <= _LOW32)
        if len(live):
            lo = low[live]
            ra = _cut(lo, rng[live])
            more = np.where(at[live] < end[live], src[np.minimum(at[live], len(words))], 0).astype(np.uint64)
            code[live] = (code[live] << _32) | more
            at[live] += 1
            low[live], rng[live] = lo << _32, ra << _32
        m.update(s)
    return out.T.reshape(-1)[:n]
