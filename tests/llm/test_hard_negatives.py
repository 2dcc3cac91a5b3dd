"""Hard negatives against brute force, the interval's guarantee, edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rampart.llm.hard_negatives import Queries, encode, hard_negatives, integer_scores, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, v string"


def brute(rows, every, positives=5, negatives=10):
    """Rows as (vec_id, vector, label), identical ones merged."""
    ok = {}
    for i, x, y in rows:
        if i is not None and y is not None and x and all(c is not None and math.isfinite(c) for c in x):
            ok[i, y, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    ok = list(ok)
    out = []
    for a in [r for r in ok if r[0] % every == 0]:
        near = [(-sum(map(int.__mul__, a[2], r[2])), r[0], r[1]) for r in ok if r is not a and len(r[2]) == len(a[2])]
        best = sorted((s, i) for s, i, y in near if y == a[1])[:positives]
        for s, i in best:
            hard = sorted((t, j) for t, j, y in near if y != a[1] and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, 5, "z") for i, x, y in rows], SCHEMA)


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, dim))
    y = rng.integers(0, labels, n)
    x = centre[rng.integers(0, labels, n)] + 0.7 * rng.standard_normal((n, dim))
    return [(i, x[i].astype(np.float32).tolist(), int(y[i])) for i in range(n)]


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold(dim):
    rng = np.random.default_rng(dim)
    v = rng.integers(-400, 400, (200, dim))
    v[:3] = 0
    v[3:5] = v[5]
    low, high = Queries(v[:60]).intervals(slice(0, 60), *encode(v))
    true = v[:60] @ v.T
    assert (low <= true).all() and (true <= high).all()
    if dim == 100:
        assert np.mean(high - low) < 1.5 * np.mean(np.linalg.norm(v, axis=1)) ** 2


def test_integer_scores_of_large_numbers():
    a = np.array([[2**40, -3], [2**62, 2**62]])
    i, j = np.repeat([0, 1], 2), np.tile([0, 1], 2)
    assert integer_scores(a, a, i, j).tolist() == [2**63 - 1, 2**63 - 1, 2**63 - 1, 2**63 - 1]
    assert integer_scores(a[:1] // 2**10, a[:1], np.array([0]), np.array([0])).tolist() == [2**63 - 1]
    assert integer_scores(np.array([[2**30, -7]]), np.array([[2**30, 5]]), np.array([0]), np.array([0])).tolist() == [2**60 - 35]


@pytest.mark.parametrize("blocks", [(40, 7), (8192, 8192)])
def test_against_brute_force(spark, blocks):
    rows = clustered(260, 24, 1)
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], (rows[0][2] + 1) % 4), (1005, rows[10][1], rows[10][2])]  # equal vectors
    got = hard_negatives(frame(spark, rows), "vec_id % 10 = 0", row_block=blocks[0], anchor_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_edges(spark):
    """Nulls, non-finite components, repeated rows and ids, other lengths, few rows, no rows."""
    rows = clustered(40, 4, 2, labels=2)
    rows += [(0, rows[0][1], rows[0][2]), (10, rows[3][1], rows[3][2]), (None, rows[0][1], 1), (50, None, 1), (60, rows[0][1], None), (70, [], 1),
             (80, [1.0, None, 2.0, 3.0], 0), (90, [float("nan"), 0.0, 0.0, 0.0], 0), (100, [float("inf"), 0.0, 0.0, 0.0], 0), (110, [0.0] * 4, 0),
             (120, [1.0, 2.0], 0), (121, [2.0, 2.0], 0), (122, [1.0, 0.5], 1), (130, [-1.0], 0), (131, [1.0], 0), (132, [3.0], 1)]
    rows += [rows[1], rows[20]]
    got = hard_negatives(frame(spark, rows), "vec_id % 10 = 0")
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert hard_negatives(frame(spark, rows).limit(0), "vec_id % 10 = 0").count() == 0
    assert hard_negatives(frame(spark, rows[1:5]), "vec_id % 10 = 0").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_hard_negatives(spark, sf).collect())) == brute(rows, 100)
