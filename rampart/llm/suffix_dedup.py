"""Byte-exact repeat removal by suffix arrays over content shards.

Every 50-byte window has a key: the smallest hash among the grams it contains. Equal windows
have equal keys, so a run of windows with one key (a tile) can be judged in the shard of that
key alone. Keys held by one document only need no further work; tiles of shared keys are sent
to their shards, where distinct tiles are laid end to end, their suffix array is induced and
the permuted common prefixes delimit the classes of equal windows. The tiles of a frequent phrase
differ by their contexts, so a key of many tile bytes is cut into its windows, each with a key
of its own. A class keeps the smallest
doc_id, and a window is removed where its document's id is larger.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.exchange import MASKS, WEIGHTED_BLOBS, KeySet, answer, layout, parted
from rampart.llm.suffix_array import permuted_lcp, suffix_array
from rampart.llm.textkit import BYTE_MASK, loads8, mix64, powers, text_bytes

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
TILES = "bucket long, part long, tiles binary, sizes binary, docs binary"
ANSWERS = "part long, bucket long, bits binary, step int"
GRAM = 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NO_DOC = np.iinfo(np.int64).max  # null ids sort after every other id
_BLOCK = 1 << 16  # arrays of a block stay in the processor's cache
SHARD_BYTES = 2 << 20  # tile bytes of a shard on average: the induced sort holds about 100 times those of repeated windows
HOT_BYTES = 2 << 20  # distinct tile bytes of one key beyond which its windows go to shards of their own
_HOT_BITS = 3  # a window sent alone takes ``window`` bytes, so cut keys are dealt to more shards


def span_hash(t: np.ndarray, start: np.ndarray, size, base: int) -> np.ndarray:
    """Polynomial hash of ``t[start:start + size]``: it deals spans out, their bytes decide."""
    pre = np.zeros(len(t) + 1, np.uint64)
    np.multiply(t, powers(base, len(t)), out=pre[1:])
    np.cumsum(pre, out=pre)
    inv = powers(pow(base, -1, 1 << 64), len(t) + 1)
    return mix64((pre[start + size] - pre[start]) * inv[start] + np.asarray(size).astype(np.uint64), 7)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def gram_hashes(t: np.ndarray, size: int, base: int) -> np.ndarray:
    """``span_hash`` of the ``size`` bytes from every position, without the final mix: the leading
    bits, which order grams, depend on all their bytes but one."""
    pre = np.zeros(len(t) + 1, np.uint64)
    np.multiply(t, powers(base, len(t)), out=pre[1:])
    np.cumsum(pre, out=pre)
    out = pre[size:] - pre[:-size]
    out *= powers(pow(base, -1, 1 << 64), len(out))
    return out


def key_runs(buf: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Runs of neighbouring windows of one document with one key: (start, windows, key, doc).

    The text is handled in blocks, so memory does not grow with a document; a run cut at a
    block's end is two runs, which changes no result as long as every pass over a part cuts it
    alike (``_ordered``).
    """
    out = []
    edges = np.concatenate([offs, np.maximum(offs[1:] - window + 1, offs[:-1])])  # first windows inside and outside
    for lo in range(0, max(1, len(buf)), _BLOCK):
        part = buf[lo:lo + _BLOCK + window - 1]
        if len(part) < window:
            break
        low = _sliding_min(gram_hashes(part, gram, _BASES[0]), window - gram + 1)
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[edges[(edges >= lo) & (edges < lo + len(low))] - lo] = True
        first = np.flatnonzero(new)
        n, start = np.diff(np.append(first, len(low))), first + lo
        doc = np.searchsorted(offs, start, side="right") - 1
        inside = start + window <= offs[doc + 1]
        out.append((start[inside], n[inside], mix64(low[first[inside]], 3), doc[inside]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    return tuple(np.concatenate(x) for x in zip(*out))


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the given spans, end to end."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return buf[np.arange(total) + shift]


def _same_bytes(buf, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` hold the same bytes, compared eight at a time."""
    at, out = loads8(buf), np.ones(len(a), bool)
    blocks = np.maximum((size + 7) >> 3, 1)
    ends = np.cumsum(blocks)
    lo = 0
    while lo < len(a):  # about a million blocks at once
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20))))
        n, m = blocks[lo:hi], size[lo:hi]
        k = np.minimum(8 * _ranges(n), np.repeat(np.maximum(m - 8, 0), n))
        diff = (at[np.repeat(a[lo:hi], n) + k] ^ at[np.repeat(b[lo:hi], n) + k]) & np.repeat(BYTE_MASK[np.minimum(m, 8)], n)
        out[lo:hi] = ~np.logical_or.reduceat(diff != 0, np.cumsum(n) - n)
        lo = hi
    return out


def _distinct(buf, start, size, *keys):
    """Spans in order of ``keys``, then content, and where a new (keys, content) begins: spans of
    one hash count as equal only if their bytes are. The last key only orders equal spans."""
    *by, last = keys
    h = span_hash(buf, start, size, _BASES[0]) if len(start) else size
    order = np.lexsort((last, size, h, *by[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (*by, h, size)])
    near = np.flatnonzero(~new)
    new[near] = ~_same_bytes(buf, start[order[near - 1]], start[order[near]], size[order[near]])
    return order, new


def tile_base(window: int, gram: int) -> int:
    """Bytes of the longest tile around one gram: what a key counts whose part names no more."""
    return 2 * window - gram


def tile_bytes(buf, start, n, keys: KeySet, window: int, gram: int) -> np.ndarray:
    """Of each key of a part, the bytes of its distinct tiles (exact above ``tile_base``)."""
    size = n + window - 1
    out = np.bincount(keys.inverse, size, len(keys.keys[0])).astype(np.int64)
    own = np.flatnonzero(out[keys.inverse] > tile_base(window, gram))
    if len(own):
        k, size = keys.inverse[own], size[own]
        order, new = _distinct(buf, start[own], size, k, k)
        rep = order[new]
        some = np.bincount(k[rep], size[rep], len(out)).astype(np.int64)
        out = np.where(some > 0, some, out)
    return out


def key_blobs(buf, offs, ids, part: int, window: int, gram: int, bits: int) -> pa.Table:
    """A part's keys for the first exchange, with the tile bytes behind them."""
    start, n, key, doc = key_runs(buf, offs, window, gram)
    keys = KeySet(key, group=ids[doc])
    return keys.blobs(part, bits, tile_bytes(buf, start, n, keys, window, gram), tile_base(window, gram))


class Tiles:
    """The distinct tiles of a part with shared keys, each with the smallest doc_id holding it."""

    def __init__(self, buf, offs, ids, masks: pa.Table, window: int, gram: int, bits: int, shard_bits: int):
        start, n, key, doc = key_runs(buf, offs, window, gram)
        keys = KeySet(key, group=doc)
        live = keys.shared(masks, bits)[keys.inverse]
        hot = keys.shared(masks, bits, "hot")[keys.inverse] & live
        if hot.any():  # keys of very many parts or tile bytes: one tile and one shard key per window
            s1 = np.repeat(start[hot], n[hot]) + _ranges(n[hot])
            d1 = np.repeat(doc[hot], n[hot])
            cold = live & ~hot
            start, n, doc, key = (np.concatenate(x) for x in (
                (start[cold], s1), (n[cold], np.ones(len(s1), np.int64)), (doc[cold], d1),
                (key[cold], mix64(span_hash(buf, s1, window, _BASES[1]), 5))))
            alone = np.arange(len(start)) >= int(cold.sum())
        else:
            start, n, key, doc = start[live], n[live], key[live], doc[live]
            alone = np.zeros(len(start), bool)
        self.start, self.n, self.doc_id = start, n, ids[doc]
        size = n + window - 1
        order, new = _distinct(buf, start, size, alone, key, self.doc_id)
        self.tile = np.empty(len(order), np.int64)
        self.tile[order] = np.cumsum(new) - 1
        self.rep = order[new]  # of each distinct tile, its occurrence in the smallest doc_id
        wide = (1 << shard_bits) + _shard_of(key[self.rep], shard_bits + _HOT_BITS)
        self.shard = np.where(alone[self.rep], wide, _shard_of(key[self.rep], shard_bits))

    def slices(self):
        if not len(self.rep):
            return
        b = self.shard
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        yield from zip(b[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(b)])


def _shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def window_minima(t: np.ndarray, size: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For every window of the tiles laid end to end in ``t`` (in text order): the smallest
    document among the tiles that hold an equal window. A window whose hash occurs once equals
    no other; the distinct runs of the others are sorted."""
    n = size - window + 1
    first = np.cumsum(n) - n
    at = np.repeat(np.cumsum(size) - size - first, n) + np.arange(int(n.sum()))
    out = np.repeat(docs, n)
    again = np.flatnonzero(_repeated(gram_hashes(t, window, _BASES[1])[at]))
    if not len(again):
        return out
    opens = np.zeros(len(at), bool)
    opens[first] = True
    new = opens[again]
    new[0] = True
    new[1:] |= again[1:] != again[:-1] + 1
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(again)))
    start, size, docs = at[again[lead]], n + window - 1, out[again[lead]]
    order, new = _distinct(t, start, size, docs)
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    rep = order[new]  # of each distinct run, its occurrence in the smallest document
    low = sorted_minima(gather(t, start[rep], size[rep]), size[rep], docs[rep], window)
    first = np.cumsum(n[rep]) - n[rep]
    out[again] = low[np.repeat(first[run], n) + _ranges(n)]
    return out


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each number occurs more than once."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(h), bool)
    out[order] = same[1:] | same[:-1]
    return out


def sorted_minima(t: np.ndarray, size: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """``window_minima`` by the suffix array of all tiles."""
    end = np.repeat(np.cumsum(size), size)
    valid = np.arange(len(t)) + window <= end
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)[sa]
    owner = np.where(valid, np.repeat(docs, size), _NO_DOC)[sa]
    new = lcp < window
    new[0] = True
    low = np.minimum.reduceat(owner, np.flatnonzero(new))
    out = np.empty(len(t), np.int64)
    out[sa] = low[np.cumsum(new) - 1]
    return out[valid]


def suffix_dedup(docs: DataFrame, window: int = 50, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                 part_bytes: int = 2 << 20, hot_parts: int = 4096, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a document
    with a smaller doc_id (texts as UTF-8, judged on the input).

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept_bytes (the remaining bytes end to end; a cut can split a character).
    Null and empty texts have 0 bytes. Texts shorter than the window lose nothing. Rows with
    the same doc_id never remove each other; a null doc_id counts as larger than all others
    and removes nothing. Other columns are ignored; an empty table gives no rows. Keys of more
    than ``hot_parts`` parts or ``hot_bytes`` tile bytes are handled window by window, which
    changes no result.
    """
    gram = min(gram, window)
    lay = layout(docs, 8 * 2 / (window - gram + 2), text, part_bytes)
    d = parted(docs, lay, doc_id, text)
    bits = lay.bucket_bits
    shard_bits = lay.bits_for(SHARD_BYTES)  # tiles add up to about the text's size

    def emit_keys(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        return key_blobs(*text_bytes(t.column("text")), _ids(t), t.column("part")[0].as_py(), window, gram, bits)

    def tiles_of(t: pa.Table, masks: pa.Table):  # of ordered rows
        buf, offs = text_bytes(t.column("text"))
        return buf, offs, Tiles(buf, offs, _ids(t), masks, window, gram, bits, shard_bits)

    def emit_tiles(t: pa.Table, masks: pa.Table) -> pa.Table:
        rows = []
        if len(t):
            part = t.column("part")[0].as_py()
            buf, _, x = tiles_of(_ordered(t), masks)
            for b, lo, hi in x.slices():
                r = x.rep[lo:hi]
                size = x.n[r] + window - 1
                rows.append((b, part, gather(buf, x.start[r], size).tobytes(), size.astype(np.int64).tobytes(), x.doc_id[r].tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                        names=["bucket", "part", "tiles", "sizes", "docs"])

    def shard(t: pa.Table) -> pa.Table:
        parts = t.column("part").to_pylist()
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        text_, sizes, ids = read("tiles", np.uint8), read("sizes", np.int64), read("docs", np.int64)
        buf, size, doc = np.concatenate(text_), np.concatenate(sizes), np.concatenate(ids)
        start = np.cumsum(size) - size
        # equal tiles of several parts are one tile of the shard, with the smallest doc_id
        order, new = _distinct(buf, start, size, doc)
        tile = np.empty(len(order), np.int64)
        tile[order] = np.cumsum(new) - 1
        rep = order[new]
        del text_
        low = window_minima(gather(buf, start[rep], size[rep]), size[rep], doc[rep], window)
        n = size[rep] - window + 1
        at = np.cumsum(n) - n
        # answer each part's tiles, window by window: is the class's document smaller?
        out, pos = [], 0
        for s in sizes:
            k = slice(pos, pos + len(s))
            pos += len(s)
            m = s - window + 1
            where = np.repeat(at[tile[k]], m) + _ranges(m)
            out.append(np.packbits(low[where] < np.repeat(doc[k], m)).tobytes())
        return pa.table({"part": pa.array(parts, pa.int64()), "bucket": t.column("bucket"), "bits": pa.array(out, pa.binary()),
                         "step": pa.array([2] * len(out), pa.int32())})

    def finish(t: pa.Table, both: pa.Table) -> pa.Table:
        t = _ordered(t)
        step = np.asarray(both.column("step"))
        first = both.filter(pa.array(step == 1))
        masks = pa.table({"part": first.column("part"), "bucket": first.column("bucket"), "shared": first.column("shared"), "hot": first.column("hot")})
        buf, offs, x = tiles_of(t, masks)
        second = both.filter(pa.array(step == 2))
        got = dict(zip(second.column("bucket").to_pylist(), second.column("shared").to_pylist()))
        n_rep = x.n[x.rep]
        at = np.cumsum(n_rep) - n_rep
        bits_ = np.zeros(int(n_rep.sum()), bool)
        for b, lo, hi in x.slices():
            m = int(n_rep[lo:hi].sum())
            bits_[at[lo]:at[lo] + m] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=m)
        # a later document of the part loses the whole tile, the first one what the shard said
        later = x.doc_id > x.doc_id[x.rep][x.tile]
        some = np.logical_or.reduceat(bits_, at) if len(at) else bits_
        k = np.flatnonzero(later | some[x.tile])
        n, within = x.n[k], _ranges(x.n[k])
        lost = np.repeat(later[k], n) | bits_[np.repeat(at[x.tile[k]], n) + within]
        opening = np.zeros(len(buf), bool)
        opening[(np.repeat(x.start[k], n) + within)[lost]] = True
        hit = np.flatnonzero(opening)
        # hit windows of one document that overlap or touch are one removed span
        doc = np.searchsorted(offs, hit, side="right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] > hit[:-1] + window) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        start, doc = hit[first], doc[first]
        end = hit[np.append(first[1:], len(hit)) - 1] + window if len(hit) else hit
        n_bytes = np.diff(offs)
        n_removed = np.bincount(doc, end - start, len(t)).astype(np.int64)
        stay = np.resize(np.array([True, False]), 2 * len(start) + 1).repeat(np.diff(np.concatenate([[0], np.stack([start, end], axis=1).ravel(), [len(buf)]])))
        raw, keep = buf[stay].tobytes(), np.append(0, np.cumsum(n_bytes - n_removed))
        kept = [raw[a:b] for a, b in zip(keep[:-1].tolist(), keep[1:].tolist())]
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "n_spans": pa.array(np.bincount(doc, minlength=len(t)), pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                         "kept_bytes": pa.array(kept, pa.binary())})

    m1 = answer(d.groupBy("part").applyInArrow(emit_keys, WEIGHTED_BLOBS), 1, hot_parts, hot_bytes, tile_base(window, gram))
    tiles = d.groupBy("part").cogroup(m1.groupBy("part")).applyInArrow(emit_tiles, TILES)
    m2 = tiles.groupBy("bucket").applyInArrow(shard, ANSWERS)
    both = (m1.select("part", "bucket", "shared", "hot", F.lit(1).alias("step"))
            .unionByName(m2.select("part", "bucket", F.col("bits").alias("shared"), F.lit(None).cast("binary").alias("hot"), "step")))
    return d.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(finish, RESULT)


def _ordered(t: pa.Table) -> pa.Table:
    """A part's rows in one order, however the shuffle delivered them: the passes over a part pair
    their tiles with the shards' answers by place."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").combine_chunks().fill_null(_NO_DOC).to_numpy(zero_copy_only=False)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Thin query: 50-byte repeats against smaller doc_ids, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).drop("kept_bytes")
