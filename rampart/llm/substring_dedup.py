"""Substring dedup over words by difference-cover anchors.

Positions are taken modulo a period v; the cover D holds residues such that any two positions
i, j have a shift d < v with both (i + d) mod v and (j + d) mod v in D. Hashing windows of
``n - v + 1`` words only at cover positions therefore meets every repeated window of n words
at an anchor both occurrences share. Anchors that occur twice are then extended: every n-word
window around them is compared by a 128-bit hash, and words under a window that starts twice
anywhere are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rampart.llm.exchange import BLOBS, KeySet, answer, layout, parted
from rampart.llm.textkit import Words, text_bytes
from pyspark.sql import functions as F

# perfect difference sets: every residue modulo the period is a difference of two members
# (fixed values)
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def cover_period(window: int) -> int:
    """The longest period that leaves anchors of at least 40 % of the window."""
    return max([v for v in COVERS if window - v + 1 >= max(2, 0.4 * window)], default=1)


def substring_dedup(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text",
                    part_bytes: int = 4 << 20) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts elsewhere.

    Words are runs of bytes outside ASCII blanks, unchanged; windows stay inside one document
    and are judged on the input, so the first occurrence goes as well. Returns one row per
    input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)
    and kept_text. Null or blank texts have 0 words and the hash of the empty string; texts
    shorter than the window lose nothing; repeated rows count as separate documents; a null
    doc_id is returned as null; other columns are ignored; an empty table gives no rows.
    """
    v = cover_period(window)
    cover = COVERS.get(v, (0,))
    anchor = window - v + 1
    is_cover = np.zeros(v, bool)
    is_cover[list(cover)] = True
    lay = layout(docs, 8 * len(cover) / v / 6, text, part_bytes)
    wide = layout_windows(lay)
    d = parted(docs, lay, doc_id, text)

    def anchors(w: Words):
        """Anchor windows of documents long enough to hold a whole window."""
        at = np.flatnonzero(is_cover[w.pos % v] & (w.pos + anchor <= w.n_words[w.doc]) & (w.n_words[w.doc] >= window)) if len(w.doc) else np.zeros(0, np.int64)
        return at, KeySet(w.window_hash(at, anchor, 1))

    def candidates(w: Words, masks: pa.Table):
        """Windows that hold a shared anchor within their first v starts, and their keys."""
        at, keys = anchors(w)
        hit = at[keys.shared(masks, lay.bucket_bits)[keys.inverse]]
        # a window starting at s holds the anchors that start in s .. s + v - 1
        mark = np.zeros(len(w.doc) + 1, np.int64)
        lo = np.maximum(hit - (v - 1), w.doc_off[w.doc[hit]])
        np.add.at(mark, lo, 1)
        np.add.at(mark, hit + 1, -1)
        s = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (w.pos + window <= w.n_words[w.doc])) if len(w.doc) else at
        return s, KeySet(w.window_hash(s, window, 2), w.window_hash(s, window, 3))

    def emit_anchors(t: pa.Table) -> pa.Table:
        _, keys = anchors(Words(*text_bytes(t.column("text"))))
        return keys.blobs(t.column("part")[0].as_py(), lay.bucket_bits)

    def emit_windows(t: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(t):
            return KeySet(np.zeros(0, np.uint64), np.zeros(0, np.uint64)).blobs(0, wide)
        _, keys = candidates(Words(*text_bytes(t.column("text"))), masks)
        return keys.blobs(t.column("part")[0].as_py(), wide)

    def finish(t: pa.Table, both: pa.Table) -> pa.Table:
        w = Words(*text_bytes(t.column("text")))
        rounds = np.asarray(both.column("step"))
        s, keys = candidates(w, both.filter(pa.array(rounds == 1)))
        dup = s[keys.shared(both.filter(pa.array(rounds == 2)), wide)[keys.inverse]]
        cover_ = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(cover_, dup, 1)
        np.add.at(cover_, dup + window, -1)
        gone = np.cumsum(cover_)[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(t)) if len(t) else np.zeros(0, np.int64)
        kept = kept_texts(w, gone)
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(w.n_words, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                         "kept_text": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())})

    m1 = answer(d.groupBy("part").applyInArrow(emit_anchors, BLOBS), 1)
    m2 = answer(d.groupBy("part").cogroup(m1.groupBy("part")).applyInArrow(emit_windows, BLOBS), 2)
    both = m1.withColumn("step", F.lit(1)).unionByName(m2.withColumn("step", F.lit(2)))
    return d.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(finish, RESULT)


def layout_windows(lay) -> int:
    """Bucket bits of the window round: its keys are twice as long and up to twice as many."""
    return lay.bucket_bits + 1


def kept_texts(w: Words, gone: np.ndarray) -> list[bytes]:
    """Per document, its kept words joined by single spaces."""
    keep = ~gone
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    n_docs = len(w.offs) - 1
    if not len(start):
        return [b""] * n_docs
    size = end - start
    # copy each kept word and one space: bytes of word k sit at where[k] .. where[k] + size[k]
    where = np.cumsum(size + 1) - size - 1
    out = np.full(int(where[-1] + size[-1] + 1), 0x20, np.uint8)
    src = np.zeros(len(w.buf) + 1, np.int8)
    np.add.at(src, start, 1)
    np.add.at(src, end, -1)
    take = np.cumsum(src)[:-1] > 0
    dst = np.ones(len(out), bool)
    dst[where + size] = False
    out[dst] = w.buf[take]
    off = np.searchsorted(doc, np.arange(n_docs + 1))
    ends = np.append(where, len(out))
    raw = out.tobytes()
    return [raw[ends[a]:max(ends[a], ends[b] - 1)] if b > a else b"" for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Thin query: 35-word substring dedup of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).drop("kept_text")
