"""Words that collide under every polynomial hash modulo 2^64 (a word of the Thue-Morse
sequence and its letter swap) are told apart by all operators."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from rampart.llm import suffix_dedup as suffix
from rampart.llm.decontaminate import find_leaks
from rampart.llm.minhash_dedup import minhash_groups, shingle_sets
from rampart.llm.substring_dedup import substring_dedup
from rampart.llm.textkit import Words, text_bytes
from rampart.llm.token_files import token_round_trip
from rampart.llm.tokens import Encoder

from . import brute

TM = ["ab"[bin(i).count("1") & 1] for i in range(1024)]
ONE = "xq" + "".join(TM) + "qx"
TWO = "xq" + "".join("ba"[c == "b"] for c in TM) + "qx"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_and_windows_differ():
    w = Words(*text_bytes(pa.array([ONE, TWO])))
    assert ONE != TWO and w.hash[0] != w.hash[1]
    a, b = (" ".join(x) for x in (TM, ["ba"[c == "b"] for c in TM]))
    w = Words(*text_bytes(pa.array([a, b])))
    for seed in (1, 2):
        assert len(set(w.window_hash(w.doc_off[:-1], 1024, seed).tolist())) == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids(name):
    enc = Encoder(public_tokenizers.path(name))
    ids, off = enc.encode(pa.array([ONE, TWO, ONE]))
    want = [e.ids for e in enc.tok.encode_batch([ONE, TWO, ONE], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_round_trip(frame(spark, [(1, ONE), (2, TWO)]), path).collect()
    enc = Encoder(path)
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: brute.crc(brute.token_ids(enc.tok, t, 2)) for i, t in ((1, ONE), (2, TWO))}


def test_near_duplicates(spark):
    rows = [(1, ONE + " p q"), (2, TWO + " p q"), (3, ONE + " p q r s t u v w x y"), (4, TWO + " p q r s t u v w x y")]
    sh, off = shingle_sets(*text_bytes(pa.array([t for _, t in rows])), 3)
    assert sh[0] != sh[off[1]]
    got = minhash_groups(frame(spark, rows), shingle=3, num=85, den=100).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_substring_dedup(spark):
    tail = " ".join(f"w{i}" for i in range(34))
    got = substring_dedup(frame(spark, [(1, f"{ONE} {tail}"), (2, f"{TWO} {tail}")])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_suffix_dedup(spark):
    rows = [(1, ONE + "!"), (2, TWO + "!"), (3, ONE + "?")]
    got = suffix.suffix_dedup(frame(spark, rows), window=50).drop("kept_bytes").collect()
    assert sorted(map(tuple, got)) == sorted(r[:5] for r in brute.suffix_dedup(rows, 50))
    buf, offs = text_bytes(pa.array([ONE[2:-2], TWO[2:-2], ONE[2:-2]]))
    start, size = offs[:-1].astype(np.int64), np.diff(offs).astype(np.int64)
    assert len(set(suffix.span_hash(buf, start, size, suffix._BASES[0]).tolist())) == 1  # the hash alone is deceived
    order, new = suffix._distinct(buf, start, size, np.arange(3))
    groups = [set() for _ in range(int(new.sum()))]
    for i, g in zip(order.tolist(), (np.cumsum(new) - 1).tolist()):
        groups[g].add(i)
    assert {1} in groups


def test_decontamination(spark):
    words = [f"w{i}" for i in range(6)]
    docs = frame(spark, [(1, " ".join([TWO, *words])), (2, " ".join([ONE, *words]))])
    items = spark.createDataFrame([(7, " ".join([ONE, *words[:4]]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == {(2, 7)}
