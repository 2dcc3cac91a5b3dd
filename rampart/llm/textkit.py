"""Vectorised text helpers shared by the corpus operators: words, word hashes and window
hashes of a whole Arrow batch of texts at once (numpy, no per-word Python)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

# words are maximal runs of bytes outside the ASCII blanks 0x09-0x0D and 0x20
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C17)  # odd and not 1 modulo 4: (a, b) and (b, a) combine differently


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), seeded."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i < n (kept per process, in steps of 2^18)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1, -(-n // (1 << 18))) << 18
        p = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


# of an 8-byte load, the bytes that belong to a span with so many bytes left
BYTE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LONG = 128  # bytes from which a span is hashed alone


def loads8(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every position (little-endian, zeros past the end), without a copy."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def byte_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes: blocks of 8 bytes chained through ``mix64``, so that no
    algebraic relation between texts makes them collide."""
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    at = loads8(buf)
    h = mix64((at[start] & BYTE_MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) << np.uint64(40)), seed)
    k, live = 8, np.flatnonzero((size > 8) & (size < _LONG))
    while len(live):
        left = size[live] - k
        h[live] = mix64(h[live] * _ODD + (at[start[live] + k] & BYTE_MASK[np.minimum(left, 8)]), seed + k)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size >= _LONG).tolist():
        d = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(d, "little")
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n + 1 row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch: byte spans, document index, position in the document, 64-bit hash.

    ``doc_off[d]:doc_off[d + 1]`` are the words of document d.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf, self.offs = buf, offs
        n_docs = len(offs) - 1
        word = np.zeros(len(buf) + 1, dtype=bool)
        np.logical_not(BLANK[buf], out=word[:-1])
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        ends = ~word
        ends[0] = False
        ends[1:] &= word[:-1]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        inner = cuts[word[cuts] & word[cuts - 1]]  # a word never crosses documents
        starts[inner] = True
        ends[inner] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.doc_off = np.searchsorted(self.start, offs)
        self.n_words = np.diff(self.doc_off)
        self.doc = np.repeat(np.arange(n_docs, dtype=np.int64), self.n_words)
        self.pos = np.arange(len(self.start), dtype=np.int64) - self.doc_off[self.doc]
        self._read = _LOWER[buf] if lower else buf
        self.hash = byte_hashes(self._read, self.start, self.end, 1)
        self._levels: dict[int, list[np.ndarray]] = {}

    def windows(self, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Start indices (into the words) of all n-word windows inside one document, and
        their hashes."""
        w = np.flatnonzero(self.pos + n <= self.n_words[self.doc]) if len(self.start) else np.zeros(0, np.int64)
        return w, self.window_hash(w, n, seed)

    def window_hash(self, w: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Hash of the n words that start at each index of ``w`` (all within the batch). Hashes of
        1, 2, 4 .. words are chained; even and odd seeds rest on different hashes of the words."""
        chain = seed & 1
        levels = self._levels.setdefault(chain, [])
        if not levels:
            levels.append(byte_hashes(self._read, self.start, self.end, 2) if chain == 0 else self.hash)
        while 2 << (len(levels) - 1) <= n:
            half, step = levels[-1], 1 << (len(levels) - 1)
            levels.append(mix64(half[:-step] * _ODD + half[step:], len(levels)) if len(half) > step else half[:0])
        out, done = np.full(len(w), seed, np.uint64), 0
        for j in range(n.bit_length() - 1, -1, -1):
            if n >> j & 1:
                out = mix64(out * _ODD + levels[j][w + done], n + j)
                done += 1 << j
        return out


def batches_of(rows, max_bytes: int, column: str):
    """Re-cut an iterator of record batches into tables of at most about ``max_bytes`` of
    ``column`` (one long text may exceed it alone), so a task's memory stays bounded."""
    held, size = [], 0
    for b in rows:
        col = b.column(b.schema.get_field_index(column))
        lens = np.diff(text_bytes(col)[1])
        start, acc = 0, size
        for i, n in enumerate(lens.tolist()):
            if acc and acc + n > max_bytes:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start, acc = [], i, 0
            acc += n
        if len(lens) > start:
            held.append(b.slice(start))
        size = acc
    if held:
        yield pa.Table.from_batches(held)


def fresh_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores before it until no taken column (in any case) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
