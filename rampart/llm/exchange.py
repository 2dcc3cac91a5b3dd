"""Key exchange between document parts: which keys of a part also occur in another part.

Documents are spread over hash parts of a few MB. A task packs the distinct 64- or 128-bit
keys of its part into one binary row per key bucket; a bucket's task sorts what all parts
sent and answers each with a bit mask in the order of the keys it got. A key held by a third
of all documents costs one entry per part, so no group grows with its copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOBS = "bucket long, part long, keys binary, multi binary"
WEIGHTED_BLOBS = f"{BLOBS}, weights binary"
MASKS = "part long, bucket long, shared binary, hot binary"
#: text bytes of a part, and key bytes a bucket receives on average
PART_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20


@dataclass(frozen=True)
class Layout:
    """How many parts and key buckets (a power of two) an input of this size gets."""

    parts: int
    bucket_bits: int
    text_bytes: int = 0

    def bits_for(self, bucket_bytes: int) -> int:
        """Bucket bits when about as many bytes as the text are dealt out."""
        return max(0, self.text_bytes // bucket_bytes).bit_length()


def layout(docs: DataFrame, keys_per_byte: float, text: str = "text", part_bytes: int = PART_BYTES) -> Layout:
    """One scan for the total text size; parts and buckets grow with it."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, int(total * keys_per_byte) // BUCKET_BYTES)
    return Layout(max(1, -(-total // part_bytes)), (buckets - 1).bit_length(), total)


def parted(docs: DataFrame, lay: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, part); the shuffle by part is planned once and reused by every pass. Rows
    that share a doc_id (or have none) are dealt by their texts."""
    part = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(lay.parts)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), part.alias("part"))


class KeySet:
    """The distinct keys of a part in sorted order, with the flag "seen twice in this part".

    ``group``: optional second identity (a document); a key then counts as seen twice only
    when two groups hold it.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray | None = None, group: np.ndarray | None = None):
        cols = [k1] if k2 is None else [k1, k2]
        order = np.argsort(k1) if k2 is None else np.lexsort((k2, k1))
        cols = [c[order] for c in cols]
        new = np.ones(len(k1), bool)
        if len(k1):
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        first = np.flatnonzero(new)
        ids = np.cumsum(new) - 1
        self.inverse = np.empty(len(k1), np.int64)  # of each given key, its place in the set
        self.inverse[order] = ids
        self.keys = [c[first] for c in cols]
        if group is None:
            self.multi = np.diff(np.append(first, len(k1))) > 1
        else:
            g = group[order]
            self.multi = np.zeros(len(first), bool)
            if len(k1):
                self.multi = np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first)

    def slices(self, bits: int):
        """(bucket, from, to): buckets are the leading bits of the first key, so contiguous."""
        if not len(self.keys[0]):
            return
        b = (self.keys[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys[0]), np.int64)
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(b)]):
            yield int(b[lo]), lo, hi

    def blobs(self, part: int, bits: int, weight: np.ndarray | None = None, base: int = 0) -> pa.Table:
        """``weight``: bytes behind each key of the set; those above ``base`` are sent along."""
        rows = [(b, part, b"".join(k[lo:hi].tobytes() for k in self.keys), np.packbits(self.multi[lo:hi]).tobytes())
                for b, lo, hi in self.slices(bits)]
        if weight is None:
            return blob_table(rows)
        above = [lo + np.flatnonzero(weight[lo:hi] > base) for _, lo, hi in self.slices(bits)]
        pairs = [np.stack([at - lo, weight[at]]).astype(np.int64).tobytes() for at, (_, lo, _) in zip(above, self.slices(bits))]
        return blob_table(rows).append_column("weights", pa.array(pairs, pa.binary()))

    def shared(self, masks: pa.Table, bits: int, column: str = "shared") -> np.ndarray:
        """The answered bits, in the order of this set."""
        out = np.zeros(len(self.keys[0]), bool)
        got = dict(zip(masks.column("bucket").to_pylist(), masks.column(column).to_pylist()))
        for b, lo, hi in self.slices(bits):
            if (m := got.get(b)) is not None:
                out[lo:hi] = np.unpackbits(np.frombuffer(m, np.uint8), count=hi - lo)
        return out


def blob_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()),
                     "keys": pa.array(cols[2], pa.binary()), "multi": pa.array(cols[3], pa.binary())})


def answer(blobs: DataFrame, key_words: int, hot_parts: int = 4096, hot_bytes: int = 0, base: int = 0) -> DataFrame:
    """Per (part, bucket): a bit per key, set when the key occurs twice in its part or in
    another part; ``hot`` marks keys held by more than ``hot_parts`` parts and, where weights were
    sent, keys of more than ``hot_bytes`` over all parts (``base`` for a part that sent none)."""

    def reduce(t: pa.Table) -> pa.Table:
        parts = t.column("part").to_pylist()
        raw = [np.frombuffer(x, np.uint64).reshape(key_words, -1) for x in t.column("keys").to_pylist()]
        lens = [x.shape[1] for x in raw]
        multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(t.column("multi").to_pylist(), lens)])
        cols = [np.concatenate([x[i] for x in raw]) for i in range(key_words)]
        order = np.lexsort(cols[::-1]) if key_words > 1 else np.argsort(cols[0], kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        dup = (count > 1) | np.logical_or.reduceat(multi[order].astype(bool), first)
        ids = np.cumsum(new) - 1
        shared, hot = np.empty(len(order), bool), np.empty(len(order), bool)
        shared[order] = dup[ids]
        ends = np.cumsum(lens).tolist()
        spans = list(zip([0, *ends], ends))
        many = count > hot_parts
        if "weights" in t.column_names:
            load = np.full(len(order), base, np.int64)
            for (a, _), w in zip(spans, t.column("weights").to_pylist()):
                at, size = np.frombuffer(w, np.int64).reshape(2, -1)
                load[a + at] = size
            many |= np.add.reduceat(load[order], first) > hot_bytes
        hot[order] = many[ids]
        return pa.table({"part": pa.array(parts, pa.int64()), "bucket": t.column("bucket"),
                         "shared": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in spans], pa.binary()),
                         "hot": pa.array([np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else None for a, b in spans], pa.binary())})

    return blobs.groupBy("bucket").applyInArrow(reduce, MASKS)
