"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document has the word count of a benchmark item and is placed so that a shared
word shingle stands where the item has it (a window that shares no shingle has similarity 0).
Its 64-bit SimHash is looked up in a multi-index: the fingerprint is cut into blocks, and two
fingerprints within the radius differ by at most radius // blocks bits in some block, so
probing those few flips in every block finds all items within the radius. Candidates are
confirmed by the exact weighted Jaccard similarity of their shingle counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.textkit import Words, batches_of, text_bytes

#: bytes of benchmark text one pass may hand to every task; larger benchmarks take more passes
ITEM_BYTES = 16 << 20
RADIUS = 20
#: (place in a document, item) pairs that are expanded at once
POSTINGS = 1 << 20
LEAKS = "doc_id long, item_id long, similarity double, start_word long, window_words long, hamming int"


def simhash(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of groups of shingle hashes (repeats weigh in); groups not empty."""
    if len(off) < 2:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(sh.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.packbits(np.add.reduceat(bits, off[:-1], axis=0) > 0, axis=1).reshape(-1).view(np.uint64)


def shingles_of(w: Words, start: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of word spans, end to end, and their offsets; spans of fewer than n words
    have one shingle."""
    k = np.where(size >= n, size - n + 1, 1)
    off = np.append(0, np.cumsum(k))
    at = np.repeat(start - off[:-1], k) + np.arange(off[-1])
    width = np.repeat(np.minimum(size, n), k)
    out = np.empty(len(at), np.uint64)
    for s in np.unique(width).tolist():
        m = width == s
        out[m] = w.window_hash(at[m], s, 1)
    return out, off


class HammingIndex:
    """Items by fingerprint block; ``near`` returns all (query, item) within the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.bits = next(b for b in (8, 16) if len(prints) <= 1 << (b + 4) or b == 16)
        self.blocks = 64 // self.bits
        flips = range(radius // self.blocks + 1)
        self.masks = np.array([sum(1 << i for i in c) for f in flips for c in combinations(range(self.bits), f)], np.int64)
        self.tables = []
        for b in range(self.blocks):
            v = self._block(prints, b)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << self.bits) + 1))))

    def _block(self, x: np.ndarray, b: int) -> np.ndarray:
        return ((x >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        n = max(1, len(self.prints))
        for lo in range(0, len(queries), 1024):
            q = queries[lo:lo + 1024]
            for b, (order, at) in enumerate(self.tables):
                probe = (self._block(q, b)[:, None] ^ self.masks).reshape(-1)
                size = at[probe + 1] - at[probe]
                who = np.repeat(np.repeat(np.arange(lo, lo + len(q)), len(self.masks)), size)
                item = order[np.repeat(at[probe] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                close = np.bitwise_count(queries[who] ^ self.prints[item]) <= self.radius
                found.append(np.unique(who[close] * n + item[close]))
        pairs = np.unique(np.concatenate(found))
        who, item = pairs // n, pairs % n
        return who, item, np.bitwise_count(queries[who] ^ self.prints[item]) if len(who) else np.zeros(0, np.uint8)


class Items:
    """A block of benchmark items, as every task holds it."""

    def __init__(self, ids: list, texts: list, shingle: int):
        self.n = shingle
        w = Words(*text_bytes(pa.array(texts, pa.large_string())), lower=True)
        some = np.flatnonzero(w.n_words > 0)
        self.ids = np.array([ids[i] for i in some.tolist()], np.int64)
        self.words = w.n_words[some].astype(np.int64)
        sh, off = shingles_of(w, w.doc_off[:-1][some].astype(np.int64), self.words, shingle) if len(some) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.counts = [Counter(sh[a:b].tolist()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        self.index = HammingIndex(simhash(sh, off))
        # shingle -> (item, place in the item)
        order = np.argsort(sh, kind="stable")
        self.keys = np.unique(sh)
        self.sorted = sh[order]
        self.first = np.append(np.searchsorted(self.sorted, self.keys), len(sh))
        self.item = np.repeat(np.arange(len(self.ids)), np.diff(off))[order]
        self.place = (np.arange(len(sh)) - np.repeat(off[:-1], np.diff(off)))[order]
        self.short = sorted({int(s) for s in self.words if s < shingle})
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def leaks(self, buf: np.ndarray, offs: np.ndarray, threshold: float) -> list[tuple]:
        """(document, item, similarity, first word, words, hamming), the best window of each
        pair of document and item (ties: the earliest)."""
        if not len(self.ids):
            return []
        w = Words(buf, offs, lower=True)
        found = []
        for size in [self.n, *self.short]:
            at, h = w.windows(size, 1)
            m = self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]
            at, h = at[m], h[m]
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            m = self.keys[k] == h
            found.append((at[m], k[m]))
        at = np.concatenate([a for a, _ in found])
        k = np.concatenate([b for _, b in found])
        if not len(at):
            return []
        size = self.first[k + 1] - self.first[k]
        ends = np.cumsum(size)
        spans, lo = np.zeros((0, 3), np.int64), 0
        while lo < len(at):  # a shingle of many items at many places: a slice of its postings at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + POSTINGS)))
            n, a = size[lo:hi], at[lo:hi]
            post = np.repeat(self.first[k[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, doc = self.item[post], np.repeat(w.doc[a], n)
            words = np.minimum(self.words[item], w.n_words[doc])
            start = np.clip(np.repeat(w.pos[a], n) - self.place[post], 0, w.n_words[doc] - words)
            spans = np.unique(np.concatenate([spans, np.stack([doc, start, words], axis=1)]), axis=0)
            lo = hi
        doc, start, words = spans.T
        sh, off = shingles_of(w, w.doc_off[doc] + start, words, self.n)
        who, item, dist = self.index.near(simhash(sh, off))
        best: dict[tuple, tuple] = {}
        counts: dict[int, Counter] = {}
        for q, i, d in zip(who.tolist(), item.tolist(), dist.tolist()):
            if q not in counts:
                counts = {q: Counter(sh[off[q]:off[q + 1]].tolist())}
            a, b = counts[q], self.counts[i]
            inter = sum(min(n, b[x]) for x, n in a.items() if x in b)
            sim = inter / (sum(a.values()) + sum(b.values()) - inter)
            if sim >= threshold:
                key, row = (int(doc[q]), i), (-sim, int(start[q]), int(words[q]), d)
                if key not in best or row < best[key]:
                    best[key] = row
        return [(d, int(self.ids[i]), -r[0], *r[1:]) for (d, i), r in sorted(best.items())]


def item_blocks(benchmark: DataFrame, shingle: int, item_id: str = "item_id", text: str = "text"):
    """The benchmark as blocks of at most about ITEM_BYTES of text: its size is measured first,
    and a larger benchmark is taken in several passes over the documents."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")) \
        .where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    k = max(1, -(-total // ITEM_BYTES))
    for i in range(k):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in got], [r.text for r in got], shingle)


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item it contains.

    Words are runs outside ASCII blanks, A-Z lower-cased. One row per pair whose best window
    has a weighted Jaccard similarity of at least ``threshold`` on ``shingle``-word shingles:
    doc_id, item_id, similarity, start_word, window_words, hamming. Null or blank texts, items
    without words and null item ids match nothing; a document shorter than an item is compared
    whole; items and texts of fewer words than a shingle are one shingle. Repeated rows repeat
    their pairs; other columns are ignored; an empty table on either side gives no rows.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for t in batches_of(batches, 1 << 19, "text"):
                ids = t.column("doc_id").to_pylist()
                rows = [(ids[d], *r) for d, *r in shared.value.leaks(*text_bytes(t.column("text")), threshold)]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES)], names=_NAMES)

        part = src.mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, that contain no item."""
    for items in item_blocks(benchmark, shingle):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for t in batches_of(batches, 1 << 19, text):
                bad = {r[0] for r in shared.value.leaks(*text_bytes(t.column(text)), threshold)}
                yield from t.filter(pa.array([i not in bad for i in range(len(t))], pa.bool_())).to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
_NAMES = [c.split()[0] for c in LEAKS.split(", ")]


def op8_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    """Thin query: the whole documents table against the whole benchmark table."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
