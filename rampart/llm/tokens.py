"""Token ids of whole texts by a public tokenizer file, with a cache of encoded pieces.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Two kinds of file
allow a text to be cut without changing its ids, so that a word is encoded once and reused:
byte-level BPE with its standard split pattern (cut before a space that stands between two
non-blanks), and BPE whose normaliser drops white space (cut at ASCII blanks). Texts for any
other file are encoded whole.

Pieces of a batch are found, hashed and looked up as arrays; only pieces not seen before pass
through the tokenizer. A cached piece is known by its bytes: the first and last eight and the
length of a piece of up to 16 bytes, the number of a longer one in a dictionary.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa

from rampart.llm.textkit import BLANK, BYTE_MASK, loads8, mix64, text_bytes

_MARKS = ".,;:!?"  # every split pattern supported here cuts between Latin letters and these
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
# letters and marks around a single line break
_BROKEN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
_JOINED = 512  # words encoded as one text
_GENERATION = 150_000  # pieces per generation of the tokenizer's own cache; two are held
_SLOTS_BITS = 22  # slots of the piece table, filled to a half at most
_LONG_BYTES = 32 << 20  # bytes of longer pieces kept
_LOOKUP = 1 << 18  # pieces looked up at once
_BLOCK = 1 << 18  # bytes handled at once

_KEPT: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per process and file."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end_id`` after every text."""
    n = len(offs) - 1
    out = np.full(len(ids) + n, end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[offs[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offs + np.arange(n + 1)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = _kind(json.load(open(path, encoding="utf-8")))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.table = PieceTable()
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that open (or close) a word
        one = self.tok.encode("\n", add_special_tokens=False).ids if self.kind == "spaced" else []
        self.line_break = one[0] if len(one) == 1 else -1
        for token, i in vocab.items():
            self.edge[i] = token.startswith("\u0120") if self.kind == "spaced" else token.endswith("</w>")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts end to end, and n + 1 offsets; null is empty."""
        if self.kind == "whole":
            got = [e.ids for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *(np.array(x, "<u4") for x in got)]), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)
        buf, offs = text_bytes(texts)
        out, sizes = [np.zeros(0, np.uint32)], []
        first = 0
        while first < len(offs) - 1:  # whole texts of about a block; a long text is a block alone
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + _BLOCK, side="right")) - 1)
            ids, n = self._block(buf[offs[first]:offs[last]], offs[first:last + 1] - offs[first])
            out.append(ids)
            sizes.append(n)
            first = last
        return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int64)

    def _block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, lone = (_spaced if self.kind == "spaced" else _blank_cut)(buf, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        if self.long_bytes > _LONG_BYTES:
            self.table.clear()
            self.long, self.long_bytes = {}, 0
        had = len(self.long)
        who = identity(buf, start, end, lone, self.long)
        if len(self.long) > had:
            self.long_bytes += sum(map(len, islice(self.long, had, None)))
        parts, counts = [], []
        for a in range(0, len(start), _LOOKUP):  # fewer than the table holds, so all fit at once
            k = slice(a, a + _LOOKUP)
            at = self.table.find(who[:, k])
            while len(new := np.flatnonzero(at < 0)):
                fresh = a + new[np.unique(slot_key(who[:, k][:, new]), return_index=True)[1]]
                times = self.table.cleared
                self._remember(buf, who[:, fresh], start[fresh], end[fresh], lone[fresh])
                if self.table.cleared == times:  # the entries found before still stand
                    at[new] = self.table.find(who[:, k][:, new])
                else:
                    at = self.table.find(who[:, k])
            lo = self.table.off[at]
            n = self.table.off[at + 1] - lo
            parts.append(self.table.ids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            counts.append(n)
        doc = np.searchsorted(offs, start, side="right") - 1
        total = np.bincount(doc, np.concatenate(counts), minlength=len(offs) - 1).astype(np.int64)
        return np.concatenate(parts), total

    def _remember(self, buf, who, start, end, lone) -> None:
        raw = buf.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        for i in np.flatnonzero(lone).tolist():
            pieces[i] = "\0" + pieces[i]
        if len(self.new) + len(pieces) > _GENERATION:
            self.old, self.new = self.new, {}
        need = set(pieces).difference(self.new)
        if need:
            self._learn(need)
        if self.table.is_full(len(pieces)):
            self.table.clear()
        ids = [self.new[p] for p in pieces]
        self.table.add(who, np.frombuffer(b"".join(ids), "<u4"), np.array(list(map(len, ids)), np.int64) // 4)

    def _learn(self, need: set[str]) -> None:
        """Cache the ids of new pieces (in "spaced" files a leading NUL marks a piece that has no
        space before it). Words, sentence marks and a line break between them are
        encoded apart; plain words are encoded many at a time."""
        new, old = self.new, self.old
        spaced = self.kind == "spaced"
        bare = "\0" if spaced else ""
        split, todo = [], set()
        for p in need:
            if (got := old.get(p)) is not None:
                new[p] = got
            elif p[-1:] in _MARKS and _plain(word := p.rstrip(_MARKS)):
                marks = bare + p[len(word):]
                split.append((p, (word, marks)))
                todo.add(word)
                todo.add(marks)
            elif spaced and "\n" in p and (m := _BROKEN(p)):
                parts = (m[1], *(["\0" + m[2]] if m[2] else []), "\0\n", "\0" + m[3], *(["\0" + m[4]] if m[4] else []))
                split.append((p, parts))
                todo.update(parts)
            else:
                todo.add(p)
        words, starts, rest = [], [], []
        for p in todo:
            if p in new:
                continue
            if (got := old.get(p)) is not None:
                new[p] = got
            elif _plain(p):
                words.append(p)
            elif p[:1] == "\0" and _plain(p[1:]):
                starts.append(p)
            else:
                rest.append(p)
        edges = self.edge
        for some, ids in self._joined(words, lambda group: " " + " ".join(group)):
            mark = np.flatnonzero(edges[ids])
            rest += self._cut(some, ids, np.append(mark, len(ids)) if spaced else np.append(0, mark + 1), 0)
        # words without a space before them: one a line
        for some, ids in self._joined(starts, lambda group: "".join([p[1:] + "\n" for p in group])):
            rest += self._cut(some, ids, np.append(0, np.flatnonzero(ids == self.line_break) + 1), 1)
        plain = [(p[1:] if p[:1] == "\0" else " " + p) if spaced else p for p in rest]
        for i in range(0, len(rest), 4096):
            for p, e in zip(rest[i:i + 4096], self.tok.encode_batch_fast(plain[i:i + 4096], add_special_tokens=False)):
                new[p] = np.array(e.ids, "<u4").tobytes()
        for p, parts in split:
            new[p] = b"".join([new[x] for x in parts])

    def _joined(self, words: list[str], join):
        """(words, ids) of groups of words that are encoded as one text each."""
        groups = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        for i in range(0, len(groups), 16):
            for some, e in zip(groups[i:i + 16], self.tok.encode_batch_fast([join(g) for g in groups[i:i + 16]], add_special_tokens=False)):
                yield some, np.array(e.ids, "<u4")

    def _cut(self, some: list[str], ids: np.ndarray, cut: np.ndarray, drop: int) -> list[str]:
        """Cache the stretches between ``cut`` (less ``drop`` ids at their ends); returns the
        pieces to encode one by one if there is not one stretch a piece."""
        if len(cut) != len(some) + 1 or cut[0] != 0 or cut[-1] != len(ids):
            return some
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        self.new.update(zip(some, [raw[a:b - 4 * drop] for a, b in zip(cut[:-1], cut[1:])]))
        return []


def slot_key(who: np.ndarray) -> np.ndarray:
    return mix64(who[0] + mix64(who[1] + mix64(who[2], 3), 4), 5)


def _plain(p: str) -> bool:
    """Latin letters only."""
    return p.isalpha() and (p.isascii() or _LETTERS(p) is not None)


class PieceTable:
    """Piece -> ids: an open-addressing table over arrays. When half full it starts anew."""

    def __init__(self):
        self.cleared = 0
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.value = np.full(1 << _SLOTS_BITS, -1, np.int32)
        self.entries = 0
        self.who = np.zeros((3, 1 << 16), np.uint64)  # by entry
        self.off, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def is_full(self, more: int) -> bool:
        """Whether ``more`` entries would fill over half of the slots."""
        return self.entries + more > 1 << (_SLOTS_BITS - 1)

    def _probe(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64) + step) & ((1 << _SLOTS_BITS) - 1)

    def find(self, who: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 if unknown."""
        key = slot_key(who)
        out = self.value[self._probe(key, 0)]
        live, step = np.arange(len(out)), 0
        while True:
            live = live[out[live] >= 0]
            e = out[live]
            live = live[(self.who[0][e] != who[0][live]) | (self.who[1][e] != who[1][live]) | (self.who[2][e] != who[2][live])]
            if not len(live):
                return out
            step += 1
            out[live] = self.value[self._probe(key[live], step)]

    def add(self, who: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces that are not in the table, each once: their ids end to end, and how many each has."""
        n = who.shape[1]
        while len(self.off) < self.entries + n + 1:
            self.off = np.append(self.off, np.zeros_like(self.off))
            self.who = np.concatenate([self.who, np.zeros_like(self.who)], axis=1)
        have = int(self.off[self.entries])
        while len(self.ids) < have + int(sizes.sum()):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[have:have + int(sizes.sum())] = ids
        self.off[self.entries + 1:self.entries + n + 1] = have + np.cumsum(sizes)
        self.who[:, self.entries:self.entries + n] = who
        value = np.arange(self.entries, self.entries + n, dtype=np.int32)
        self.entries += n
        key, live, step = slot_key(who), np.arange(n), 0
        while len(live):
            slot = self._probe(key[live], step)
            free = self.value[slot] < 0
            self.value[slot[free]] = value[live[free]]  # of pieces that meet in a slot one stays
            live, step = live[self.value[slot] != value[live]], step + 1


def _blank_cut(buf: np.ndarray, offs: np.ndarray):
    """Pieces between ASCII blanks."""
    word = np.append(~BLANK[buf], False)
    starts, ends = word.copy(), ~word
    starts[1:] &= ~word[:-1]
    ends[0] = False
    ends[1:] &= word[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    inner = cut[word[cut] & word[cut - 1]]
    starts[inner] = ends[inner] = True
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends), np.zeros(len(start), bool)


def _spaced(buf: np.ndarray, offs: np.ndarray):
    """Pieces cut at spaces that stand between two characters that are surely not blank; the
    first piece of a text has no space before it (lone). Characters of more than one byte that
    could be blank (by their first byte) make no cut."""
    n = len(buf)
    sp = np.flatnonzero(buf == 0x20)
    sp = sp[(sp > 0) & (sp < n - 1)]
    before, after = buf[sp - 1], buf[sp + 1]
    two, three = buf[np.maximum(sp - 2, 0)], buf[np.maximum(sp - 3, 0)]
    wide = (before >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    ok = ~BLANK[before] & ~BLANK[after] & ~wide & (after != 0xC2) & ((after < 0xE1) | (after > 0xE3))
    sp = sp[ok]
    doc = np.searchsorted(offs, sp, side="right") - 1
    sp = sp[(sp > offs[doc]) & (sp < offs[doc + 1] - 1)]
    heads = offs[:-1][np.diff(offs) > 0]
    start = np.sort(np.concatenate([heads, sp + 1]))
    lone = np.ones(len(start), bool)
    lone[np.searchsorted(start, sp + 1)] = False
    stops = np.sort(np.concatenate([offs[1:][np.diff(offs) > 0], sp]))
    return start, stops, lone


def identity(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lone: np.ndarray, long: dict[bytes, int]):
    """Three 64-bit numbers that tell pieces apart exactly, one a column: the first eight bytes, the last
    eight, length and ``lone``. Pieces of more than 16 bytes have their number in ``long``."""
    size = end - start
    at = loads8(buf)
    who = np.empty((3, len(start)), np.uint64)
    who[0] = at[start] & BYTE_MASK[np.minimum(size, 8)]
    who[1] = np.where(size > 8, at[np.maximum(end - 8, start)], 0)
    who[2] = 2 * size + lone
    wide = np.flatnonzero(size > 16)
    if len(wide):
        raw = [buf[a:b].tobytes() for a, b in zip(start[wide].tolist(), end[wide].tolist())]
        who[0][wide] = [long.setdefault(r, len(long)) for r in raw]
        who[1][wide] = 0
    return who


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    plain = spec.get("post_processor") is None and not any(
        a.get("lstrip") or a.get("rstrip") or any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens", []))
    if plain and not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = {n["type"] for n in norm.get("normalizers", [])}
    splits = [p for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    if (plain and steps <= {"NFC", "Replace", "Lowercase"} and len(splits) == 1 and splits[0]["invert"]
            and splits[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", "")):
        return "words"
    return "whole"
