"""Aggregation rules and attacks on the fixed 10-client matrix (8 honest near 1, clients 8 and 9 at -50)."""

import math

import pytest
from pyspark.sql import functions as F

from rampart.operators import robust as R

N_CLIENTS, N_PARAMS = 10, 6


def _matrix():
    rows = []
    for c in range(N_CLIENTS):
        for p in range(N_PARAMS):
            v = -50.0 if c >= 8 else 1.0 + 0.05 * math.sin(7 * c + p)
            rows.append((c, p, v))
    return rows


@pytest.fixture(scope="module")
def updates(spark):
    return spark.createDataFrame(_matrix(), "client_id int, pos int, value double").cache()


@pytest.fixture(scope="module")
def clients(spark):
    return spark.createDataFrame([(c, 100.0, 0.5, int(c >= 8)) for c in range(N_CLIENTS)],
                                 "client_id int, num_examples double, train_loss double, malicious int")


def _vals(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_fedavg_is_dragged_by_attackers(updates, clients):
    assert all(v < -5 for v in _vals(R.fedavg(updates, clients)))


def test_median_is_robust(updates):
    assert all(abs(v - 1) < 0.2 for v in _vals(R.coordinate_median(updates)))


def test_trimmed_mean_is_robust(updates):
    assert all(abs(v - 1) < 0.2 for v in _vals(R.trimmed_mean(updates, 0.2)))


def test_trimmed_zero_equals_mean(updates):
    mean = {r["pos"]: r["m"] for r in updates.groupBy("pos").agg(F.avg("value").alias("m")).collect()}
    got = {r["pos"]: r["value"] for r in R.trimmed_mean(updates, 0.0).collect()}
    assert all(abs(got[p] - mean[p]) < 1e-12 for p in mean)


def test_krum_picks_honest(updates):
    sel = [r["client_id"] for r in R.krum_select(updates, 2).where("selected").collect()]
    assert len(sel) == 1 and sel[0] < 8
    assert all(abs(v - 1) < 0.2 for v in _vals(R.krum(updates, 2)))


def test_multikrum_excludes_attackers(updates):
    sel = {r["client_id"] for r in R.krum_select(updates, 2, multi=True).where("selected").collect()}
    assert 8 not in sel and 9 not in sel and len(sel) == 8


def test_f_is_clamped_for_small_federation(spark):
    u = spark.createDataFrame([(c, p, float(c + p)) for c in range(4) for p in range(3)],
                              "client_id int, pos int, value double")
    s = R.krum_scores(u, 3).collect()
    assert {r["f_used"] for r in s} == {0}


def test_lone_and_pair_clients_all_selected(spark):
    u = spark.createDataFrame([(c, p, float(c)) for c in range(2) for p in range(3)],
                              "client_id int, pos int, value double")
    assert R.krum_select(u, 0).where("selected").count() == 2
    one = spark.createDataFrame([(0, p, 1.0) for p in range(3)], "client_id int, pos int, value double")
    assert R.krum_select(one, 0).where("selected").count() == 1


def test_unknown_method_raises(updates, clients):
    with pytest.raises(ValueError):
        R.aggregate("nope", updates, clients)


def test_flatten_round_trip(spark):
    coef = spark.createDataFrame([(c, f, float(c * 3 + f)) for c in range(2) for f in range(3)],
                                 "class int, feature int, value double")
    inter = spark.createDataFrame([(0, 7.0), (1, 8.0)], "class int, value double")
    flat = R.flatten_params(coef, inter, 3, 2)
    assert [r["value"] for r in flat.orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5, 7, 8]
    c2, i2 = R.unflatten_params(flat, 3, 2)
    assert sorted(map(tuple, c2.collect())) == sorted(map(tuple, coef.collect()))
    assert sorted(map(tuple, i2.collect())) == sorted(map(tuple, inter.collect()))


def test_attack_literals(spark):
    df = spark.createDataFrame([(i, y, 1) for i, y in enumerate([0, 1, 1, 0])], "i int, label_id int, malicious int")
    assert [r["train_label"] for r in R.flip_labels(df, 2).orderBy("i").collect()] == [1, 0, 0, 1]
    u = spark.createDataFrame([(0, 0, 1.0)], "client_id int, pos int, value double")
    g = spark.createDataFrame([(0, 0.0)], "pos int, value double")
    c = spark.createDataFrame([(0, 1)], "client_id int, malicious int")
    assert R.poison_updates(u, g, c, 3.0).head()["value"] == -3.0
    n = spark.range(1).select(R.num_malicious(F.lit(0.2), F.lit(10)).alias("a"),
                              R.num_malicious(F.lit(0.3), F.lit(10)).alias("b"),
                              R.num_malicious(F.lit(0.25), F.lit(10)).alias("half_even")).head()
    assert (n["a"], n["b"], n["half_even"]) == (2, 3, 2)


def test_keys_run_many_configs_in_one_job(updates, clients):
    a = updates.crossJoin(updates.sparkSession.createDataFrame([(0,), (1,)], "cfg int"))
    out = R.trimmed_mean(a, 0.2, keys=["cfg"]).groupBy("cfg").count().collect()
    assert sorted((r["cfg"], r["count"]) for r in out) == [(0, N_PARAMS), (1, N_PARAMS)]


def test_pairwise_distances_across_blocks_match_brute_force(spark):
    """Several coordinate blocks (block 4, 11 coordinates) with one coordinate missing on a client."""
    import numpy as np

    rng = np.random.default_rng(7)
    m = rng.normal(size=(5, 11))
    rows = [(c, p, float(m[c, p])) for c in range(5) for p in range(11) if not (c == 3 and p == 9)]
    u = spark.createDataFrame(rows, "client_id int, pos int, value double")
    got = {(r["c1"], r["c2"]): r["d"] for r in R.pairwise_sq_distances(u, block=4).collect()}
    assert len(got) == 20
    for i in range(5):
        for j in range(5):
            if i == j:
                continue
            keep = [p for p in range(11) if not ({i, j} & {3} and p == 9)]
            want = float(((m[i, keep] - m[j, keep]) ** 2).sum())
            assert got[(i, j)] == pytest.approx(want, rel=1e-12)


def test_many_clients_meet_in_buckets(spark):
    """Distances are those of one bucket, and no key holds all pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5))
    up = spark.createDataFrame([(g, c, p, float(v[c, p] + g)) for g in (0, 1) for c in range(60) for p in range(5)], "g int, client_id int, pos int, value double")
    want = {(g, a, b): float(((v[a] - v[b]) ** 2).sum()) for g in (0, 1) for a in range(60) for b in range(60) if a != b}
    for bucket in (7, 100):
        got = {(r.g, r.c1, r.c2): r.d for r in R.pairwise_sq_distances(up, ["g"], block=2, bucket=bucket).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    alone = R.pairwise_sq_distances(up.where("g = 0").drop("g"), bucket=7)
    assert alone.count() == 60 * 59 and alone.agg(F.sum("d")).first()[0] > 0
