"""SentencePiece encoding, spans and decoding against the sentencepiece library."""

import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from rampart.llm.sentence_pieces import (CharMap, ModelFile, PieceEncoder, decode_pieces, encode_pieces, normalise,
                                         op11_sentence_pieces)
from rampart.llm.textkit import text_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(MODEL, "rb").read()
ODD = [None, "", " ", "  ", " \n", "  a   b ", "▁▁ x\0y", "日本語 𐍈x\n\n\tq", "éé", "éé ①㍿ ＡＢ　Ｃ", "a" * 300, "ab " * 2000,
       "▁" * 100 + "x", "<s></s><0x0A> <unk>", "🙂🙂 🙂", "​� x ", "the" * 100 + " " + "é" * 90, "­­", "x ­"]


def texts(seed, n=200):
    rng = random.Random(seed)
    alphabet = list("ab é▁\n🙂日xyz  the") + ["é", "①", "㍿", "　", "Ａ", " ", "​", "ﬁ", "한"]
    return [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(n))]


def with_normalizer(name, **flags):
    """The model with another normaliser: later fields of a message replace earlier ones."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    spec = ModelFile(proto).char_map
    field = lambda number, raw: bytes([number << 3 | 2]) + varint(len(raw)) + raw
    numbers = {"add_dummy_prefix": 3, "remove_extra_whitespaces": 4, "escape_whitespaces": 5}
    body = field(2, spec) + b"".join(bytes([numbers[k] << 3, int(v)]) for k, v in flags.items())
    return RAW + field(3, body)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


VARIANTS = [RAW, with_normalizer("nmt_nfkc", remove_extra_whitespaces=True), with_normalizer("nfkc_cf", remove_extra_whitespaces=False),
            with_normalizer("nmt_nfkc", remove_extra_whitespaces=True, add_dummy_prefix=False)]


@pytest.mark.parametrize("raw", VARIANTS, ids=["file", "nfkc", "casefold", "no prefix"])
def test_ids_spans_and_text(raw):
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    enc = PieceEncoder(raw)
    some = texts(3)
    ids, off, begin, stop = enc.encode(pa.array(some), end=True)
    said = enc.decode(ids, off)
    for i, t in enumerate(some):
        t = t or ""
        a, b = off[i], off[i + 1]
        want = lib.encode(t, add_eos=True)
        assert ids[a:b].tolist() == want, repr(t)
        assert said[i] == lib.decode(want), repr(t)
        spans = [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces] + [(len(t.encode()),) * 2]
        assert list(zip(begin[a:b].tolist(), stop[a:b].tolist())) == spans, repr(t)


def test_normalised_text():
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    lib, model = sentencepiece.SentencePieceNormalizer(model_proto=proto), ModelFile(proto)
    some = [t or "" for t in texts(4)]
    out, off, align, _ = normalise(model, CharMap(model.char_map), *text_bytes(pa.array(some)))
    for i, t in enumerate(some):
        assert out[off[i]:off[i + 1]].tobytes().decode() == lib.normalize(t), repr(t)


def test_decode_any_ids(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    rows = [[], [2], [1, 259, 259], [3 + 0xE6, 3 + 0x97], [259, 3 + 0xF0, 3 + 0x9F, 500, 3 + 0x99], [0, 259, 300], [35], [28705, 28705]]
    rows += [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(rows)] + [(-1, None, "old")], "id long, ids array<int>, decoded string")
    got = {r.id: r.decoded for r in decode_pieces(df, MODEL).collect()}
    assert got.pop(-1) is None
    assert got == {i: lib.decode(x) for i, x in enumerate(rows)}


def test_small_tables(monkeypatch):
    """Tables that overflow and are emptied change no id."""
    import rampart.llm.tokens as module

    monkeypatch.setattr(module, "_SLOTS_BITS", 11)
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceEncoder(RAW)
    for t in texts(5, 120):
        assert enc.encode(pa.array([t]))[0].tolist() == lib.encode(t or "")


def test_unsupported_files_are_refused():
    with pytest.raises(ValueError):
        PieceEncoder(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())


def test_frames(spark):
    """Nulls, repeated rows, extra columns with clashing names, an empty table, the thin query."""
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "a b", 7), (1, "a b", 7), (None, "é\n", 8), (3, None, 9), (4, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_pieces(df, MODEL).collect()
    want = [(i, lib.encode(t or "", add_eos=True), lib.decode(lib.encode(t or ""))) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert [(r.begins, r.ends) for r in got if r.doc_id == 1][0] == ([0, 1, 3], [1, 3, 3])
    assert encode_pieces(df.limit(0), MODEL).count() == 0 and encode_pieces(df, MODEL, end=False).where("doc_id = 3").first().ids == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in op11_sentence_pieces(spark, sf).collect()} == want
