"""SentencePiece encoding with offsets, from the model file itself.

A text is normalised by longest-prefix matches in the file's compiled character map (a double
array over UTF-8 bytes); every normalised byte keeps the place of the source it came from. The
normalised text is cut into units before each space mark that follows another character; no
piece of the vocabulary reaches over such a cut, so merges inside a unit are those of the whole
text. Units not seen before are merged many at a time, as rows of a symbol matrix. A piece's
bytes are known from its id, so running sums place each piece in the normalised text and the
alignment projects it to the bytes of the original.

BPE files with byte fallback and without user-defined or unused pieces are supported.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.textkit import batches_of, text_bytes
from rampart.llm.tokens import PieceTable, identity, slot_key, with_end

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # piece types of the file format (fixed values)
_NONE = np.int32(2**31 - 1)
_WIDTHS = (1, 6, 9, 12, 16, 24, 40, 64)  # symbols of a matrix row; longer units are merged one by one
_BLOCK = 1 << 18

ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


# ------------------------------------------------------------------ model file
def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message; floats and bytes stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, raw[at:at + n]
        at += n


class ModelFile:
    """Pieces (text, score, type) and the settings that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
            elif number == 2:
                trainer.update(_fields(value))
            elif number == 3:
                normal.update(_fields(value))
        self.is_bpe, self.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
        self.space_last = bool(trainer.get(24, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.end_piece = trainer.get(47, b"</s>").decode()
        self.char_map = normal.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))


# ------------------------------------------------------------------ normalisation
class CharMap:
    """Longest-prefix replacement by the compiled map, at all places of a text at once."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).astype(np.int64)
        self.text = np.frombuffer(blob, np.uint8, offset=4 + n)
        self.stops = np.flatnonzero(self.text == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and value of the longest key that starts at each place (0: none)."""
        size, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, node, k = np.arange(len(at)), np.full(len(at), self._offset(self.units[:1])[0]), 0
        while len(live):
            inside = at[live] + k < end[live]
            live, node = live[inside], node[inside]
            c = buf[at[live] + k].astype(np.int64)
            node = node ^ c
            fits = node < len(self.units)
            live, node, c = live[fits], node[fits], c[fits]
            unit = self.units[node]
            same = (unit & (1 << 31 | 255)) == c
            live, node, unit = live[same], node[same], unit[same]
            node = node ^ self._offset(unit)
            k += 1
            leaf = (unit >> 8 & 1).astype(bool)
            size[live[leaf]] = k
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return size, value

    def apply(self, buf: np.ndarray, offs: np.ndarray):
        """Replaced bytes, the chunk and source byte of each, and the chunks' texts."""
        starts = np.flatnonzero((buf & 0xC0) != 0x80)
        doc = np.searchsorted(offs, starts, side="right") - 1
        size, value = self.longest(buf, starts, offs[doc + 1])
        char = np.diff(np.append(starts, len(buf)))
        reached = np.ones(len(starts), bool)
        for i in np.flatnonzero(size > char).tolist():  # keys of several characters
            if reached[i]:
                reached[i + 1:np.searchsorted(starts, starts[i] + size[i])] = False
        starts, doc, size, value, char = (x[reached] for x in (starts, doc, size, value, char))
        hit = size > 0
        src = np.where(hit, len(buf) + value, starts)
        n = char.copy()
        n[hit] = self.stops[np.searchsorted(self.stops, value[hit])] - value[hit]
        chunk = np.repeat(np.arange(len(n)), n)
        both = np.concatenate([buf, self.text])
        return both[np.repeat(src - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], chunk, starts[chunk], doc[chunk]


def normalise(model: ModelFile, char_map: CharMap | None, buf: np.ndarray, offs: np.ndarray):
    """Normalised bytes of all texts end to end, their n + 1 offsets, the source byte (within
    its text) of each normalised byte, and of each text the source byte where it ends."""
    n_docs = len(offs) - 1
    size = np.diff(offs)
    final = size.copy()
    if char_map is None:
        first = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0)) if len(buf) else np.zeros(0, np.int64)
        raw, chunk, source, doc = buf, first, first, np.repeat(np.arange(n_docs), size)
    else:
        raw, chunk, source, doc = char_map.apply(buf, offs)
    source = source - offs[doc]
    some, lead = size > 0, np.zeros(n_docs, np.int64)  # texts that get a prefix, and the source byte it stands at
    blank = raw == 0x20
    if model.trim and len(raw):
        new = np.append(True, chunk[1:] != chunk[:-1])  # the first byte of its chunk
        opens = np.append(True, doc[1:] != doc[:-1])
        solid = np.cumsum(~blank)
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        # a chunk's blanks in front go after a chunk that ends in a blank, and at a text's start
        heading = blank & (solid == (solid - ~blank)[at][which])
        after = opens[at] | np.append(True, blank[at[1:] - 1])
        drop = heading & after[which]
        # a text's blanks at the end go; its source ends where the first of them stood
        last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(raw))))
        bound = np.searchsorted(doc, np.arange(n_docs + 1))
        for d in np.flatnonzero(bound[1:] > bound[:-1]).tolist():
            a, b = int(bound[d]), int(bound[d + 1])
            stop = max(a, int(last[b - 1]) + 1)
            kept = np.flatnonzero(~drop[stop:b])
            if stop == a:  # blanks alone
                some[d] = False
                drop[a:b] = True
                final[d] = 0
                continue
            if len(kept):
                final[d] = source[stop + kept[0]]
            drop[stop:b] = True
            lead[d] = source[a + int(np.argmin(blank[a:b]))] if blank[a] else 0
        raw, source, doc, blank = raw[~drop], source[~drop], doc[~drop], blank[~drop]
    elif model.trim:
        some[:] = False
    wide = 3 if model.escape else 1
    mark = _SPACE if model.escape else np.array([0x20], np.uint8)
    n = np.where(blank, wide, 1)
    add = np.where(some & model.dummy_prefix, wide, 0)
    per_doc = np.bincount(doc, n, n_docs).astype(np.int64)
    front, back = (np.zeros_like(add), add) if model.space_last else (add, np.zeros_like(add))
    out_offs = np.append(0, np.cumsum(per_doc + add))
    to = np.cumsum(n) - n + (np.cumsum(front) + np.cumsum(back) - back)[doc]
    out = np.empty(int(out_offs[-1]), np.uint8)
    align = np.empty(len(out), np.int64)
    out[to] = raw
    align[to] = source
    for k in range(wide):
        out[to[blank] + k] = mark[k]
        align[to[blank] + k] = source[blank]
        d = np.flatnonzero(add)
        where = (out_offs[1:] - wide if model.space_last else out_offs[:-1])[d] + k
        out[where] = mark[k]
        align[where] = final[d] if model.space_last else lead[d]
    return out, out_offs, align, final


# ------------------------------------------------------------------ merges
class Merges:
    """Pairs of symbols that merge. A symbol is a piece's id, or past all ids a character that
    is no piece."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.base = len(pieces)
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        symbol = lambda s: ids.get(s, self.base + ord(s) if len(s) == 1 else None)
        self.of_char = np.arange(self.base, self.base + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.span = self.base + 0x110000 + 1
        self.pad = self.span - 1
        order = {s: r for r, s in enumerate(sorted({-pieces[i][1] for i in ids.values()}))}
        rows = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    rows.append((a * self.span + b, order[-pieces[i][1]], i))
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 3).T
        self.keys, self.rank, self.made = np.append(cols[0], np.iinfo(np.int64).max), np.append(cols[1], _NONE), np.append(cols[2], 0)
        self.table = {k: (r, i) for k, r, i in rows}

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no rank where it does not merge."""
        key = a * self.span + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), self.made[at]

    def merge_rows(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge every row of a symbol matrix (padded at its right) to its end: the best pair
        first, the leftmost of equals. Returns (rows, their symbols, padded) as they end."""
        out = []
        who = np.arange(len(s))
        rank, made = self.find(s[:, :-1], s[:, 1:])
        while len(who):
            row, w = np.arange(len(who)), s.shape[1]
            if w == 1:
                out.append((who, s))
                break
            j = rank.argmin(axis=1)
            ended = rank[row, j] == _NONE
            if ended.any():
                out.append((who[ended], s[ended]))
                on = ~ended
                who, s, rank, made, j = who[on], s[on], rank[on], made[on], j[on]
                row = np.arange(len(who))
            s[row, j] = made[row, j]
            skip = np.arange(w - 1)
            s = np.take_along_axis(s, skip + (skip > j[:, None]), axis=1)
            skip = np.arange(w - 2)
            skip = skip + (skip >= j[:, None])
            rank, made = np.take_along_axis(rank, skip, axis=1), np.take_along_axis(made, skip, axis=1)
            for k in (j - 1, j):  # the pairs beside the merged symbol
                ok = np.flatnonzero((k >= 0) & (k < w - 2))
                rank[ok, k[ok]], made[ok, k[ok]] = self.find(s[ok, k[ok]], s[ok, k[ok] + 1])
        return out

    def merge_long(self, s: list[int]) -> list[int]:
        """The same for one long unit, with a heap over a linked list."""
        before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (got := self.table.get(s[i] * self.span + s[j])):
                heapq.heappush(heap, (got[0], i, s[i], s[j], got[1]))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in s if x >= 0]


class PieceEncoder:
    """Encodes and decodes batches of texts; one a process and file (``piece_encoder``)."""

    def __init__(self, raw: bytes):
        self.model = m = ModelFile(raw)
        kinds = {k for _, _, k in m.pieces}
        if not m.is_bpe or not m.byte_fallback or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} \
                or any(SPACE in p.lstrip(SPACE) for p, _, k in m.pieces if k == _NORMAL):
            raise ValueError("only BPE files with byte fallback whose pieces hold the space mark in front are supported")
        self.char_map = CharMap(m.char_map) if m.char_map else None
        self.merges = Merges(m.pieces)
        kind = np.array([k for _, _, k in m.pieces])
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(m.pieces) if k == _BYTE}
        self.end_id = next((i for i, (p, _, k) in enumerate(m.pieces) if p == m.end_piece and k == _CONTROL), None)
        # of each id: its bytes in a normalised text, and what it decodes to
        self.width = np.array([1 if k == _BYTE else len(p.encode()) if k == _NORMAL else 0 for p, _, k in m.pieces], np.int64)
        text = {_NORMAL: lambda p: p.replace(SPACE, " ").encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)]),
                _CONTROL: lambda p: b"", _UNKNOWN: lambda p: bytes(m.unknown_text)}
        said = [text[k](p) for p, _, k in m.pieces]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_off = np.append(0, np.cumsum([len(x) for x in said])).astype(np.int64)
        self.is_control = kind == _CONTROL
        self.opens = np.array([k == _NORMAL and p.startswith(SPACE) for p, _, k in m.pieces])
        self.table, self.long = PieceTable(), {}

    # -- units
    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, end to end, and how many each has."""
        m = self.merges
        n = end - start
        raw = buf[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        symbols = m.of_char[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        off = chars[np.append(0, np.cumsum(n))]
        size = np.diff(off)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (units, rows of symbols)
        low = 0
        for w in _WIDTHS:
            at = np.flatnonzero((size > low) & (size <= w))
            low = w
            if len(at):
                col = np.arange(w)
                s = np.where(col < size[at][:, None], symbols[np.minimum(off[at][:, None] + col, len(symbols) - 1)], m.pad)
                done += [(at[who], rows) for who, rows in m.merge_rows(s)]
        for i in np.flatnonzero(size > _WIDTHS[-1]).tolist():
            done.append((np.array([i]), np.array([m.merge_long(symbols[off[i]:off[i + 1]].tolist())], np.int64)))
        # the rows end to end, in the order of the units
        unit, flat = [], []
        for who, rows in done:
            real = rows != m.pad
            unit.append(np.repeat(who, real.sum(axis=1)))
            flat.append(rows[real])
        unit, flat = np.concatenate(unit), np.concatenate(flat)
        order = np.argsort(unit, kind="stable")
        unit, flat = unit[order], flat[order]
        odd = np.flatnonzero(flat >= m.base)
        if len(odd):  # characters that are no piece: their bytes
            said = [[self.byte_id[b] for b in chr(x - m.base).encode()] for x in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(x) for x in said]
            unit = np.repeat(unit, times)
            to = (np.cumsum(times) - times)[odd]
            flat = np.repeat(flat, times)
            for i, x in zip(to.tolist(), said):
                flat[i:i + len(x)] = x
        return flat, np.bincount(unit, minlength=len(n))

    def _ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, and how many each text has."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        mark = np.zeros(n, bool)
        if self.model.escape:
            mark[:-2] = (buf[:-2] == _SPACE[0]) & (buf[1:-1] == _SPACE[1]) & (buf[2:] == _SPACE[2])
        else:
            mark[:] = buf == 0x20
        wide = 3 if self.model.escape else 1
        cut = mark.copy()
        cut[wide:] &= ~mark[:-wide]
        cut[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if sum(map(len, self.long)) > 1 << 25:
            self.table.clear()
            self.long = {}
        who = identity(buf, start, end, np.zeros(len(start), bool), self.long)
        at = self.table.find(who)
        while len(new := np.flatnonzero(at < 0)):
            fresh = new[np.unique(slot_key(who[:, new]), return_index=True)[1]]
            if self.table.is_full(len(fresh)):
                self.table.clear()
            self.table.add(who[:, fresh], *self._learn(buf, start[fresh], end[fresh]))
            at = self.table.find(who)
        lo = self.table.off[at]
        size = self.table.off[at + 1] - lo
        ids = self.table.ids[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        doc = np.searchsorted(offs, start, side="right") - 1
        return ids, np.bincount(doc, size, len(offs) - 1).astype(np.int64)

    # -- texts
    def encode(self, texts: pa.Array, end: bool = False):
        """Ids of all texts end to end, their n + 1 offsets, and each id's first and past-the-last
        byte in its own text. Null is empty; ``end`` puts the file's end id after every text."""
        buf, offs = text_bytes(texts)
        parts, first = [], 0
        while first < len(offs) - 1:  # whole texts of about a block
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + _BLOCK, side="right")) - 1)
            parts.append(self._block(buf[offs[first]:offs[last]], offs[first:last + 1] - offs[first]))
            first = last
        ids, begin, stop, n = ([p[k] for p in parts] for k in range(4))
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(kind) for x, kind in ((ids, "<u4"), (begin, np.int64), (stop, np.int64))]
        off = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *n]))).astype(np.int64)
        if end:
            size = np.diff(offs)
            spans = []
            for x in flat[1:]:  # the end stands past a text's last byte
                more = np.insert(x, off[1:], size)
                spans.append(more)
            flat[0], off = with_end(flat[0], off, self.end_id)
            flat[1:] = spans
        return flat[0], off, flat[1], flat[2]

    def _block(self, buf: np.ndarray, offs: np.ndarray):
        norm, noffs, align, final = normalise(self.model, self.char_map, buf, offs)
        ids, n = self._ids(norm, noffs)
        to = np.cumsum(self.width[ids])
        doc = np.repeat(np.arange(len(n)), n)
        begin = align[to - self.width[ids]] if len(ids) else np.zeros(0, np.int64)
        inside = to < noffs[1:][doc]
        stop = np.where(inside, align[np.minimum(to, len(align) - 1)], final[doc]) if len(ids) else begin
        return ids, begin, stop, n

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The text of each id list: the space mark that opens its first visible piece goes, and
        every byte that is no UTF-8 is a replacement character."""
        ids = np.asarray(ids, np.int64)
        lo = self.said_off[ids]
        size = self.said_off[ids + 1] - lo
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        if self.model.dummy_prefix or self.model.trim:
            seen = np.flatnonzero(~self.is_control[ids])
            head = seen[np.append(True, doc[seen][1:] != doc[seen][:-1])] if len(seen) else seen
            head = head[self.opens[ids[head]]]
            lo = lo.copy()
            lo[head] += 1
            size[head] -= 1
        raw = self.said[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
        to = np.append(0, np.cumsum(size))
        ends = to[offs].tolist()
        out = [_text(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        # bytes on both sides of a control id make no character together
        mid = 1 + np.flatnonzero(self.is_control[ids[1:-1]] & (size[1:-1] == 0) & (size[:-2] <= 1) & (size[2:] <= 1)) if len(ids) > 2 else []
        for d in np.unique(doc[mid]).tolist():
            cuts = [ends[d], *to[[i for i in range(offs[d], offs[d + 1]) if self.is_control[ids[i]]]].tolist(), ends[d + 1]]
            out[d] = "".join([_text(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(c if not "\udc80" <= c <= "\udcff" else "�" for c in raw.decode(errors="surrogateescape"))


_KEPT: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _KEPT:
        with open(path, "rb") as f:
            _KEPT[path] = PieceEncoder(f.read())
    return _KEPT[path]


def encode_pieces(docs: DataFrame, model_path: str, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's piece ids, where each piece stands in it, and the text the ids decode to.

    One row per input row: doc_id, ids, begins and ends (bytes of the UTF-8 text; a character
    that is spelt in bytes belongs to its last byte's id, the ids before it are empty, as is the
    end id), decoded. A null or empty text has the end id alone (no id without ``end``); a null
    doc_id is returned as null; repeated rows are kept; other columns are ignored; an empty table
    gives no rows. Nothing is shuffled; a task holds one batch of texts.
    """

    def run(batches):
        enc = piece_encoder(model_path)
        for t in batches_of(batches, 1 << 20, "text"):
            ids, off, begin, stop = enc.encode(t.column("text"), end)
            at = pa.array(off, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, begin, stop)]
            yield from pa.table([t.column("doc_id"), *lists, pa.array(enc.decode(ids, off), pa.string())],
                                names=["doc_id", "ids", "begins", "ends", "decoded"]).to_batches()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, ENCODED)


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded`` (replacing one of that name): the text of the id list
    ``ids``; null for null. Ids the file does not have raise an error."""
    src = rows.drop("decoded")
    names = src.columns

    def run(batches):
        enc = piece_encoder(model_path)
        for b in batches:
            col = b.column(names.index(ids)).cast(pa.list_(pa.int32()))
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(enc.width):
                raise ValueError("id outside the vocabulary")
            null = col.is_null().to_pylist()
            off = np.append(0, np.cumsum([0 if n else len(x) for n, x in zip(null, col)])).astype(np.int64)
            said = [None if n else s for n, s in zip(null, enc.decode(flat, off))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema), "decoded string"])
    return src.mapInArrow(run, schema)


def op11_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Thin query: ids with the end id, and the decoded text, of the whole documents table."""
    import public_tokenizers

    got = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
