"""Substring, suffix, line and near-duplicate removal against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from rampart.llm import suffix_dedup as SD
from rampart.llm.components import components
from rampart.llm.exchange import KeySet, answer
from rampart.llm.line_dedup import line_dedup
from rampart.llm.minhash_dedup import band_count, minhash_groups
from rampart.llm.substring_dedup import COVERS, cover_period, substring_dedup
from rampart.llm.suffix_array import _by_doubling, permuted_lcp, suffix_array
from rampart.llm.suffix_dedup import Tiles, key_blobs, suffix_dedup, tile_base
from rampart.llm.textkit import text_bytes

from . import brute

DOCS = "doc_id long, text string, rep string, part long, n_bytes long, chunk long, centre boolean"


def frame(spark, rows):
    """Extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, True) for i, t in rows], DOCS)


def corpus(seed=1, n=60):
    """Texts that share passages, with nulls, empties, a long text and repeated rows."""
    rng = random.Random(seed)
    vocab = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("éxyz.") for _ in range(25)]
    passage = [" ".join(rng.choices(vocab, k=rng.randint(8, 40))) for _ in range(5)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(["\n", "  ", "\t", " "]) + rng.choice(passage)
        rows.append((3 * i - 7, text))
    rows += [(500, None), (501, ""), (502, " \n\t"), (None, passage[0]), (None, passage[1]), (503, rows[4][1]), (504, rows[4][1].upper()),
             (505, "aa " * 3000), (506, "é" * 300), (507, "\0 a\0b " + passage[2]), rows[7]]
    return rows


def multiset(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window", [6, 16, 35])
def test_substring_dedup(spark, window):
    rows = corpus(window)
    got = substring_dedup(frame(spark, rows), window=window, part_bytes=1500)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert multiset([tuple(r)[:4] for r in got.collect()]) == multiset(brute.substring_dedup(rows, window))


def test_rows_of_one_id_are_dealt_to_many_parts(spark):
    """Rows without an id, or with one id, spread over parts and give what brute force gives."""
    from rampart.llm.exchange import layout, parted

    rows = [(None if i % 3 else 7, t) for i, (_, t) in enumerate(corpus(4))]
    df = frame(spark, rows)
    lay = layout(df, 0.1, part_bytes=1500)
    assert parted(df, lay).select("part").distinct().count() > lay.parts / 2
    got = substring_dedup(df, window=16, part_bytes=1500)
    assert multiset([tuple(r)[:4] for r in got.collect()]) == multiset(brute.substring_dedup(rows, 16))
    got = suffix_dedup(df, window=30, part_bytes=1500).drop("kept_bytes")
    assert multiset([tuple(r) for r in got.collect()]) == multiset([r[:5] for r in brute.suffix_dedup(rows, 30)])


def test_cover_property():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert cover_period(35) == 21 and cover_period(1) == 1


@pytest.mark.parametrize("window,hot", [(20, 4096), (50, 4096), (30, 1)])
def test_suffix_dedup(spark, window, hot):
    """hot=1 sends every key of two parts or more window by window, as very frequent keys go."""
    rows = corpus(window)
    got = suffix_dedup(frame(spark, rows), window=window, part_bytes=1500, hot_parts=hot)
    assert multiset([tuple(r)[:5] for r in got.collect()]) == multiset(brute.suffix_dedup(rows, window))


def test_tiles_do_not_depend_on_the_order_of_rows(monkeypatch):
    """Each pass may get a part's rows in another order and pairs its tiles with the answers by
    place, so blocks must be cut alike."""
    monkeypatch.setattr(SD, "_BLOCK", 1000)
    rows, rng = [r for r in corpus(3) if r[0] is not None], random.Random(2)
    seen = []
    for _ in range(3):
        t = SD._ordered(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows], pa.string())}))
        buf, offs = text_bytes(t.column("text"))
        start, n, key, doc = SD.key_runs(buf, offs, 50, 20)
        ids = SD._ids(t)[doc]
        order, new = SD._distinct(buf, start, n + 49, key, ids)
        seen.append([(int(key[k]), int(n[k]), int(ids[k])) for k in order[new]])
        rng.shuffle(rows)
    assert seen[0] == seen[1] == seen[2]


def phrase_docs(n=480):
    """A 40-byte phrase in a third of the texts, each time in another context."""
    rng = random.Random(8)
    noise = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    phrase = "all rights reserved, see terms of use 40"
    rows = [(i, noise(60) + (phrase if i % 3 == 0 else "") + noise(60)) for i in range(n)]
    return rows + [(n + i, rows[9 * i][1]) for i in range(20)]


def test_suffix_dedup_of_a_frequent_phrase(spark):
    rows = phrase_docs()
    got = suffix_dedup(frame(spark, rows), part_bytes=8000, hot_bytes=1000)
    assert multiset([tuple(r)[:5] for r in got.collect()]) == multiset(brute.suffix_dedup(rows, 50))


def test_frequent_phrase_is_cut_in_few_parts(spark):
    """12 parts, far below hot_parts: no shard gets the tiles of all contexts of the phrase."""
    rows, window, gram, bits = phrase_docs(), 50, 20, 6
    parts = [(*text_bytes(pa.chunked_array([[t for _, t in rows[p::12]]], pa.string())), np.array([i for i, _ in rows[p::12]])) for p in range(12)]
    blobs = spark.createDataFrame([r for p, x in enumerate(parts) for r in key_blobs(*x, p, window, gram, 0).to_pylist()],
                                  "bucket long, part long, keys binary, multi binary, weights binary")

    def largest(hot_bytes):
        masks, load = answer(blobs, 1, 4096, hot_bytes, tile_base(window, gram)).toArrow(), {}
        for p, x in enumerate(parts):
            t = Tiles(*x, masks.filter(pc_equal(masks, p)), window, gram, 0, bits)
            for b, lo, hi in t.slices():
                load[b] = load.get(b, 0) + int((t.n[t.rep[lo:hi]] + window - 1).sum())
        return max(load.values())

    assert largest(1 << 30) > 5000 > 2 * largest(1500)


def test_key_runs_by_brute_force(monkeypatch):
    """Runs of one smallest gram hash, cut at documents and blocks, with empty and short texts."""
    rng, window, gram, block = random.Random(4), 12, 5, 40
    monkeypatch.setattr(SD, "_BLOCK", block)
    texts = ["", "short"] + ["".join(rng.choices("ab\0", k=rng.randint(0, 90))) for _ in range(20)] + ["", "a" * 100, "x" * window, ""]
    buf, offs = text_bytes(pa.chunked_array([texts], pa.string()))
    got = list(zip(*(x.tolist() for x in SD.key_runs(buf, offs, window, gram))))
    grams = SD.gram_hashes(buf, gram, SD._BASES[0]).tolist()
    assert grams[3] == SD.gram_hashes(buf[3:3 + gram], gram, SD._BASES[0])[0]  # of the bytes alone, wherever they stand
    want, before = [], None
    for d in range(len(texts)):
        for at in range(int(offs[d]), int(offs[d + 1]) - window + 1):
            key = (min(grams[at:at + window - gram + 1]), d, at // block)
            if key == before and want and want[-1][0] + want[-1][1] == at:
                want[-1][1] += 1
            else:
                want.append([at, 1, d])
            before = key
    assert [[s, n, d] for s, n, _, d in got] == want
    named = {}
    for s, n, key, _ in got:
        for at in range(s, s + n):
            assert named.setdefault(min(grams[at:at + window - gram + 1]), key) == key
    assert len(set(named.values())) == len(named)


def test_key_runs_cost_less_than_a_sort():
    """Three passes find the runs of every text, so they must stay cheap beside one sort of as many numbers."""
    rng = np.random.default_rng(5)
    buf, offs = rng.integers(97, 123, 2 << 20).astype(np.uint8), np.arange(0, (2 << 20) + 1, 2048)
    numbers = rng.integers(0, 1 << 62, len(buf))

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: SD.key_runs(buf, offs, 50, 20)) < 0.18 * seconds(lambda: np.argsort(numbers, kind="stable"))


def test_key_set_of_groups():
    """A key seen twice counts only where two groups hold it, in whatever order they come."""
    keys = KeySet(np.array([5, 3, 5, 7, 3, 7, 7], np.uint64), group=np.array([2, 1, 2, 4, 6, 9, 4]))
    assert keys.keys[0].tolist() == [3, 5, 7] and keys.multi.tolist() == [True, False, True]
    assert keys.inverse.tolist() == [1, 0, 1, 2, 0, 2, 2]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    for op in (substring_dedup, suffix_dedup, minhash_groups, line_dedup):
        assert op(none).collect() == []


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(0)
    for case in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 150)).astype(np.uint8)
        if case % 3 == 0:
            t = np.tile(t, 4)[:250]
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(t).tolist() == want
        assert _by_doubling(t).tolist() == want
        plcp = permuted_lcp(t, np.array(want))
        for r in range(1, len(b)):
            i, j, n = want[r], want[r - 1], 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert plcp[i] == n


def test_suffix_array_recursion():
    """Few distinct substrings in a long text take the recursive branch."""
    t = np.random.default_rng(3).integers(0, 2, 6000).astype(np.uint8)
    b = t.tobytes()
    assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_key_exchange(spark):
    """Keys of two parts or twice in one part are shared; hot marks keys of many parts."""
    sets = {p: KeySet(np.array(k, np.uint64) << np.uint64(60)) for p, k in {0: [1, 2, 2, 9], 1: [3, 9], 2: [9, 4, 1]}.items()}
    blobs = spark.createDataFrame([r for p, s in sets.items() for r in s.blobs(p, 2).to_pylist()], "bucket long, part long, keys binary, multi binary")
    got = answer(blobs, 1, hot_parts=2).toArrow()
    shared = {p: dict(zip((s.keys[0] >> np.uint64(60)).tolist(), s.shared(got.filter(pc_equal(got, p)), 2).tolist())) for p, s in sets.items()}
    assert shared == {0: {1: True, 2: True, 9: True}, 1: {3: False, 9: True}, 2: {1: True, 4: False, 9: True}}
    assert sets[0].shared(got.filter(pc_equal(got, 0)), 2, "hot").tolist() == [False, False, True]


def pc_equal(t, p):
    import pyarrow.compute as pc

    return pc.equal(t.column("part"), p)


@pytest.mark.parametrize("n,num", [(3, 85), (5, 80)])
def test_minhash_groups(spark, n, num):
    rng = random.Random(n)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(8):
        words = rng.choices(vocab, k=rng.randint(40, 120))
        for copy in range(rng.randint(1, 8)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows) * 2 + 10, " ".join(w).capitalize()))
    # a chain: neighbours are linked, its ends are not
    words = rng.choices(vocab, k=200)
    for step in range(6):
        rows.append((400 - step, " ".join(words[8 * step:8 * step + 150])))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two\tWORDS"), (904, "one"), (905, "q " * 5000), (906, "q " * 4000)]
    want = brute.minhash_groups(rows, n, num, 100)
    got = {r.doc_id: r for r in minhash_groups(frame(spark, rows), shingle=n, num=num, den=100).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert want[400][1] == 395 if n == 3 else True


def test_minhash_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j"
    got = minhash_groups(frame(spark, [(None, text), (None, text), (1, text), (1, text), (2, text), (1, "z y x w v")])).collect()
    assert multiset([(r.doc_id, r.component_id, r.kept) for r in got]) == multiset([(None, None, True)] * 2 + [(1, 1, True)] * 3 + [(2, 1, False)])


def test_minhash_links_between_key_members(spark):
    """Members of one key that its smallest document does not link are compared among each
    other: texts that share a half, and pairs that are close."""
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(500)]
    half = rng.choices(vocab, k=60)
    rows = []
    for pair in range(12):
        rest = rng.choices(vocab, k=60)
        rows += [(10 * pair, " ".join(half + rest)), (10 * pair + 1, " ".join(half + rest[:-1] + ["zz"]))]
    want = brute.minhash_groups(rows, 3, 85, 100)
    got = minhash_groups(frame(spark, rows), shingle=3, num=85, den=100, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_minhash_group_just_below_the_threshold(spark):
    """300 texts made of one by replaced words: most are similar and yet not linked, some are."""
    from rampart.llm import minhash_dedup as module

    rng = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([2, 3, 3, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:  # a partner that only this text has
            rows.append((1000 + i, " ".join(w[:-1] + [f"y{i}"])))
    counted = []
    real = module.verified

    def watch(pairs, *a):
        counted.append(pairs.count())
        return real(pairs, *a)

    module.verified = watch
    try:
        got = {r.doc_id: r.component_id for r in minhash_groups(frame(spark, rows), shingle=3, num=85, den=100).collect()}
    finally:
        module.verified = real
    want = {i: c for i, (_, c) in brute.minhash_groups(rows, 3, 85, 100).items()}
    assert got == want and len(set(want.values())) > 100
    assert counted[1] < 3000  # of 54,000 pairs


def test_band_count():
    assert (1 - 0.85**2) ** band_count(0.85, 2) <= 5e-5


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (300, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


def test_line_dedup(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 14))) for _ in range(25)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            edit = rng.random()
            at = rng.randrange(len(w))
            if edit < 0.2:
                w[at] = rng.choice(vocab)
            elif edit < 0.4:
                w.insert(at, rng.choice(vocab))
            elif edit < 0.6 and len(w) > 1:
                del w[at]
            lines.append(rng.choice([" ", "\t", "  "]).join(w) + rng.choice(["", " ", "\r"]))
        rows.append((i * 5 - 40, "\n".join(lines) + rng.choice(["", "\n", "\n \n"])))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "r " * 4000), (1004, "r " * 3999 + "s"), (1005, "r " * 4001), (1006, "a a a a a a a a b"), (None, base[0])]
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows)).collect()}
    want = brute.line_dedup(rows, 8)
    assert {i: (r.n_lines, r.n_removed, r.text) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 30
    assert got[1000].rep == "x" and got[1000].chunk == 3


def test_line_dedup_repeated_rows_and_nulls(spark):
    rows = [(1, "one line here\nsecond"), (1, "one line here\nsecond"), (2, "second"), (None, "second\nthird"), (None, "third")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup(frame(spark, rows)).collect()]
    same = (1, "one line here\nsecond", 0)
    assert got.count(same) == 2 and (2, "", 1) in got
    # rows without an id are one document, after all others; each of its rows has its lines once
    assert sorted(r[1:] for r in got if r[0] is None) == [("third", 0), ("third", 1)]


def test_line_dedup_within_a_document_and_by_shuffle(spark, monkeypatch):
    import rampart.llm.line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_DOCS", 0)
    line = "a b c d e f g h i j"
    rows = [(1, f"{line}\nx\n{line}\n{line} k\nx"), (0, "y"), (2, line.replace("d", "D"))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(frame(spark, rows)).collect()}
    assert got == {1: (f"{line}\nx", 3), 0: ("y", 0), 2: ("", 1)}


def test_line_dedup_stays_native(spark):
    plan = line_dedup(frame(spark, [(1, "a\nb"), (2, "a")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_only_repeated_windows_are_sorted(monkeypatch):
    """A shard's windows by their bytes: tiles with repeats inside, across and around them; what occurs once is not sorted."""
    rng = np.random.default_rng(12)
    sorted_bytes = []
    monkeypatch.setattr(SD, "suffix_array", lambda t: sorted_bytes.append(len(t)) or suffix_array(t))
    for alphabet, window in ((4, 6), (200, 50), (1, 5)):
        shared = rng.integers(0, alphabet, 2 * window).astype(np.uint8)
        tiles = [rng.integers(0, alphabet, int(n)).astype(np.uint8) for n in rng.integers(window, 4 * window, 300)]
        tiles[10:20] = [np.concatenate([t, shared[i:i + window + i // 2], t]) for i, t in enumerate(tiles[10:20])]
        tiles[30], tiles[31] = shared[:window], shared
        size, docs = np.array([len(t) for t in tiles]), rng.integers(0, 50, 300)
        owner: dict[bytes, int] = {}
        pieces = [(t[i:i + window].tobytes(), int(d)) for t, d in zip(tiles, docs) for i in range(len(t) - window + 1)]
        for p, d in pieces:
            owner[p] = min(owner.get(p, d), d)
        sorted_bytes.clear()
        assert SD.window_minima(np.concatenate(tiles), size, docs, window).tolist() == [owner[p] for p, _ in pieces]
        assert alphabet < 200 or sum(sorted_bytes) < size.sum() / 10
    once = rng.permutation(200).astype(np.uint8)
    sorted_bytes.clear()
    assert SD.window_minima(once, np.array([100, 100]), np.array([3, 1]), 50).tolist() == [3] * 51 + [1] * 51 and not sorted_bytes


def test_removed_spans_meet_at_document_ends(spark):
    """Spans that touch are one in a document and two where a document ends between them."""
    a, b, c = ("".join(chr(first + int(x)) for x in np.random.default_rng(first).integers(0, 10, 50)) for first in (48, 65, 97))
    rows = [(1, a), (2, b), (3, a + b), (4, a), (5, b), (6, a + c + b), (7, c), (8, a + "." + b), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup(df).collect()}
    assert got == {1: (50, 0, 0, a.encode()), 2: (50, 0, 0, b.encode()), 3: (100, 100, 1, b""), 4: (50, 50, 1, b""), 5: (50, 50, 1, b""),
                   6: (150, 100, 2, c.encode()), 7: (50, 50, 1, b""), 8: (101, 100, 2, b"."), 9: (0, 0, 0, b"")}
