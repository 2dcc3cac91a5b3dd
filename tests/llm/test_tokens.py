"""Packing, the context-mixing coder and token files."""

import io
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rampart.llm.context_coder import decode_block, encode_block, lanes_for
from rampart.llm.packing import Packer, pack_documents
from rampart.llm.shared_files import new_folder
from rampart.llm.token_files import TokenReader, TokenWriter, read_token_files, token_round_trip, write_token_files
from rampart.llm.tokens import Encoder

from . import brute

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " a  b", "x\n y \n\nz", "\tq", " lead trail ", "don't stop <|endoftext|> now<|endoftext|>x", "a\0b c", "\0 a b", "é è à b c",
       "A B\x1c C 123 45 6!! ??", "ΑΣ Σ ς", "a ́b", "it's  'll 'd", "word, word. Word! Ünïcode,; ×÷ a×b", "the cat sat on the mat. " * 2000]
DOCS = "doc_id long, text string, start long, length long, part long, rep string"


def texts(seed, n):
    rng = random.Random(seed)
    syllables = ["the", "ing", "on", "é", "ß", "Re", "ou", "na", "'s", "42"]
    return [rng.choice([" ", "\n"]).join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", ".", ",", "!?"]) for _ in range(rng.randint(0, 900))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, 7, "x") for i, t in rows], DOCS)


def encoded(enc, some):
    ids, offs = enc.encode(pa.array(some, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_whole_text_encoding(path):
    tok, enc = Tokenizer.from_file(path), Encoder(path)
    assert enc.kind != "whole"
    some = [*ODD, *texts(1, 40)]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    for _ in range(2):  # cold, then from the cache
        assert encoded(enc, some) == want
    assert encoded(enc, []) == [] and encoded(enc, [None, ""]) == [b"", b""]


def test_encoder_small_tables(monkeypatch):
    """Tables that overflow, and pieces whose hashes are equal, change no id."""
    import rampart.llm.tokens as module

    tok = Tokenizer.from_file(BYTE)
    some = [*ODD, *texts(2, 12)]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    monkeypatch.setattr(module, "_GENERATION", 50)
    monkeypatch.setattr(module, "_SLOTS_BITS", 9)
    monkeypatch.setattr(module, "_LOOKUP", 100)
    enc = Encoder(BYTE)
    assert [encoded(enc, [t])[0] for t in some] == want
    key = module.slot_key
    monkeypatch.setattr(module, "slot_key", lambda who: key(who) | np.uint64(0xFFFFFFFFFFFFFFF8))
    monkeypatch.setattr(module, "_LONG_BYTES", 40)
    enc = Encoder(BYTE)
    assert len(want[-1]) and [encoded(enc, [t])[0] for t in some] == want


def test_sum_of_squares_choice():
    """The chosen level has the smallest sum of squared counts of partial windows."""
    rng = random.Random(3)
    p = Packer(16)
    for _ in range(300):
        size = rng.randint(1, 15)
        best = []
        for level in range(16 - size + 1):
            if level and not p.count[level]:
                continue
            n = p.count.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            best.append((int((n.astype(int) ** 2).sum()), -level))
        assert p.level_for(size) == -min(best)[1]
        p.put(0, np.arange(size, dtype="<u4"))
    assert not p.count[0] and not p.count[16]


def check_pieces(rows, ids, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, want in ids.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), brute.crc(want[at:at + r.length]))
            at += r.length
        assert at == len(want)
    assert not by_doc
    odd = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == seq[0].sequence_tokens <= window
        assert at == window or at & (at - 1) == 0
        odd += at != window
    return len(by_seq), odd


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *texts(4, 150)])]
    tok = Tokenizer.from_file(BYTE)
    ids = {i: brute.token_ids(tok, t, 1) for i, t in rows}
    for window, parts in ((2048, 1), (64, 3)):
        got = pack_documents(frame(spark, rows).repartition(parts), BYTE, window=window).collect()
        n, odd = check_pieces(got, ids, window)
        assert odd <= 12 * parts
        assert n <= sum(map(len, ids.values())) // window + 12 * parts


def test_packing_edges(spark):
    assert pack_documents(frame(spark, []).limit(0), BYTE).collect() == []
    got = pack_documents(frame(spark, [(None, None), (1, "a"), (1, "a")]), BYTE).collect()
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in got) == [("1", 2, 2), ("1", 2, 2), ("None", 1, 1)]


@pytest.mark.parametrize("n,vocab", [(0, 10), (1, 1), (5, 3), (257, 7), (5000, 50), (20_000, 49_408), (3000, 2)])
def test_coder_round_trip(n, vocab):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, vocab, n), np.minimum(rng.geometric(0.3, n) - 1, vocab - 1), np.arange(n) % vocab, np.full(n, vocab - 1)):
        lanes = lanes_for(n)
        words, per_lane = encode_block(ids, vocab, lanes)
        assert (decode_block(words, per_lane, n, vocab) == ids).all()


def test_coder_learns_contexts():
    """A repeated phrase costs far less than its order-0 entropy."""
    phrase = np.random.default_rng(0).integers(0, 5000, 60)
    words, per_lane = encode_block(np.tile(phrase, 400), 5000, lanes_for(24_000))
    assert len(words) * 32 / 24_000 < 2.5


def test_token_file_blocks_and_checksums():
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 300, int(n)).astype("<u4")) for i, n in enumerate(rng.integers(0, 900, 40))]
    out = io.BytesIO()
    w = TokenWriter(out, 300, block_ids=1000)
    for i, ids in docs:
        w.add(i, ids.tobytes())
    w.close()
    raw = out.getvalue()
    reader = TokenReader(io.BytesIO(raw))
    assert reader.blocks == w.blocks > 10
    start = 0
    for (i, ids), got in zip(docs, reader.documents(), strict=True):
        assert got == (i, start, len(ids), brute.crc(ids))
        start += len(ids)
    for at in (60, len(raw) // 2, len(raw) - 12):
        broken = bytearray(raw)
        broken[at] ^= 4
        with pytest.raises(Exception):
            list(TokenReader(io.BytesIO(bytes(broken))).documents())
    with pytest.raises(ValueError):
        TokenWriter(io.BytesIO(), 1 << 20)


def test_token_files(spark):
    rows = [(50 - i, t) for i, t in enumerate([*ODD, *texts(6, 30)])] + [(None, "null id"), (7, "again"), (7, "again")]
    tok = Tokenizer.from_file(WORD)
    data = frame(spark, rows).repartition(5)
    manifest = write_token_files(data, new_folder(spark, "t"), WORD)
    got = read_token_files(manifest).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    left, at = defaultdict(list), 0
    for i, t in rows:
        left[i].append(brute.token_ids(tok, t, 2))
    for r in got:
        match = [k for k, ids in enumerate(left[r.doc_id]) if (len(ids), brute.crc(ids)) == (r.n_tokens, r.ids_crc32)]
        assert match and r.start == at
        left[r.doc_id].pop(match[0])
        at += r.n_tokens
    assert token_round_trip(data.limit(0), WORD).collect() == []
