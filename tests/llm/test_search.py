"""Projected neighbours and benchmark decontamination against brute force."""

import random

import numpy as np
import pytest

from rampart.llm import decontaminate
from rampart.llm.ann import Leaves, Space, chi2_cdf, chi2_quantile, nearest_neighbours
from rampart.llm.decontaminate import HammingIndex, find_leaks, without_leaks

from . import brute

VECS = "vec_id long, embedding array<double>, cell long, sub long, block long, score string, rank int"


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 1, 2, 3, "s", 4) for i, v in rows], VECS)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_chi_square():
    assert chi2_cdf(15.507, 8) == pytest.approx(0.95, abs=1e-4)
    assert chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_neighbours_exact_when_confident(spark):
    """With a confidence near 1 everything near enough is verified; ties go to smaller ids."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6) * rng.uniform(0.5, 2)) for i in range(300)]
    same = rng.normal(size=6)
    rows += [(1000 + i, same) for i in range(60)]  # more equal vectors than k
    rows += [(2000, None), (2001, [0] * 6), (2002, [1, None, 0, 0, 0, 0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, []), (2006, [1, 2])]
    got = answers(nearest_neighbours(vec_frame(spark, rows), "vec_id % 10 = 0", k=7, confidence=0.999999, cell_rows=40, block_queries=16))
    usable = [(i, v) for i, v in rows if i not in (2005, 2006)]
    want = brute.neighbours(usable, lambda i: i % 10 == 0, 7)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    rows = [(i, c) for i, c in enumerate(centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 32)))]
    got = answers(nearest_neighbours(vec_frame(spark, rows), "vec_id % 100 = 0", k=10, cell_rows=200))
    want = brute.neighbours(rows, lambda i: i % 100 == 0, 10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_neighbours_few_and_none(spark):
    rows = [(0, [1.0, 0]), (1, [0.5, 0.5]), (2, [0, 3.0])]
    got = answers(nearest_neighbours(vec_frame(spark, rows), "vec_id = 0"))
    assert [i for i, _ in got[0]] == [1, 2]
    assert nearest_neighbours(vec_frame(spark, []).limit(0), "true").collect() == []
    assert nearest_neighbours(vec_frame(spark, [(1, None)]), "true").collect() == []


@pytest.mark.parametrize("cell_rows", [40, 20_000])
def test_neighbours_of_repeated_rows(spark, cell_rows):
    """Every row, queries too, occurs three times: the same k neighbours as without copies."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6) * rng.uniform(0.5, 2)) for i in range(300)]
    got = answers(nearest_neighbours(vec_frame(spark, rows * 3), "vec_id % 10 = 0", k=20, confidence=0.999999, cell_rows=cell_rows))
    want = brute.neighbours(rows, lambda i: i % 10 == 0, 20)
    assert {q: [i for i, _ in got[q]] for q in got} == {q: [i for i, _ in want[q]] for q in want}


def test_neighbours_of_ids_with_several_vectors(spark):
    """100 ids with three vectors each: 20 ids, each once, with the best product of the pair."""
    rng = np.random.default_rng(6)
    rows = [(i % 100, rng.normal(size=6) * rng.uniform(0.5, 2)) for i in range(300)]
    got = answers(nearest_neighbours(vec_frame(spark, rows), "vec_id % 10 = 0", k=20, confidence=0.999999, cell_rows=40))
    assert set(got) == set(range(0, 100, 10))
    for q, found in got.items():
        score = {c: max(float(a @ b) for i, a in rows if i == q for j, b in rows if j == c) for c in range(100) if c != q}
        want = sorted(score, key=lambda c: (-score[c], c))[:20]
        assert [i for i, _ in found] == want
        assert np.allclose([s for _, s in found], [score[c] for c in want], rtol=0, atol=1e-12)


def test_cells_and_leaves_hold_every_point():
    rng = np.random.default_rng(3)
    s = Space(5, 30.0)
    p = rng.normal(size=(500, 8))
    s.split(p[:100], 8)
    cell = s.cell(p)
    assert s.cells == 8 and all((s.lo[c] <= x).all() and (x <= s.hi[c]).all() for c, x in zip(cell, p))
    leaves = Leaves(np.concatenate([p, np.repeat(p[:1], 200, axis=0)]))
    assert sorted(leaves.order.tolist()) == list(range(700)) and int(np.diff(leaves.span).sum()) == 700


def test_hamming_index_finds_all():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    q = np.array([int(base[i]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 26), replace=False)) for i in rng.integers(0, 400, 200)], np.uint64)
    for radius in (3, 20):
        who, item, dist = HammingIndex(base, radius).near(q)
        want = {(a, b) for a in range(200) for b in range(400) if bin(int(q[a]) ^ int(base[b])).count("1") <= radius}
        assert set(zip(who.tolist(), item.tolist())) == want
        assert (dist <= radius).all()
    assert len(HammingIndex(base[:0]).near(q)[0]) == 0


def leak_case():
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(200)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for i in range(25)]
    docs = []
    for d in range(60):
        text = rng.choices(vocab, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() for x in w]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(text)))
    items += [(100, None), (101, ""), (None, "no id at all here"), (102, items[3][1])]
    docs += [(200, None), (201, ""), (202, items[5][1]), (None, items[6][1]), (203, " ".join(items[7][1].split()[:3])), (204, (items[8][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("item_bytes", [16 << 20, 800])
def test_leaks(spark, monkeypatch, item_bytes):
    """item_bytes=800: the benchmark takes several passes."""
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    docs, items = leak_case()
    d = spark.createDataFrame([(i, t, 9, "y") for i, t in docs], "doc_id long, text string, item_id long, similarity string")
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    want = brute.leaks(docs, [(i, t) for i, t in items if i is not None and t], 5, 0.8)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(d, b).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    clean = without_leaks(d, b)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if not any(k[0] == i for k in want))
    assert find_leaks(d.limit(0), b).collect() == [] and find_leaks(d, b.limit(0)).collect() == []
