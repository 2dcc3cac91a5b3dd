"""Round loop end to end on the flow fixture (sf0.001): log shape, attack bookkeeping, reports."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rampart.operators import report as RP
from rampart.plans import centralized as CZ
from rampart.plans import federated as FD
from rampart.sources import io as IO


@pytest.fixture(scope="module")
def sets(spark):
    return CZ.flow_training_sets(spark, SF_SMALL)


def test_clean_run_log(spark, sets):
    tr, va, te, nf, nc = sets
    log = FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(rounds=2, run_name="clean")).collect()
    assert [r["round"] for r in log] == [0, 1, 2]
    assert log[0]["clients"] is None and log[1]["clients"] == 5
    assert log[1]["bytes_up"] == 5 * (nc * nf + nc) * 8
    assert all(0 <= r["accuracy"] <= 1 and r["loss"] > 0 for r in log)


def test_krum_run_under_model_poison(spark, sets):
    tr, va, te, nf, nc = sets
    d = tempfile.mkdtemp(prefix="rampart-runs-")
    cfg = FD.RunConfig(rounds=2, aggregation="multikrum", attack="model_poison", malicious_fraction=0.4,
                       partition_alpha=0.5, run_name="mk_poison")
    log = FD.run_federated(spark, tr, te, va, nf, nc, cfg, log_dir=d).collect()
    assert log[1]["malicious_in_round"] == 2 and log[1]["kept_clients"] == 4
    # poisoned updates are far from the honest ones: Multi-Krum keeps at most one attacker
    assert log[1]["malicious_kept"] <= 1
    runs = IO.scan_round_logs(spark, d)
    summary = RP.run_summary(runs.withColumn("clients", F.col("clients").cast("int"))).collect()
    assert len(summary) == 1 and summary[0]["rounds"] == 2


def test_label_flip_changes_training_labels(spark, sets):
    tr, va, te, nf, nc = sets
    cfg = FD.RunConfig(rounds=1, attack="label_flip", malicious_fraction=0.2, run_name="flip")
    rows = FD.prepare_silo_rows(tr, cfg, nc, spark)
    flipped = rows.where("malicious = 1").where(F.col("train_label") == F.lit(nc - 1) - F.col("label_id")).count()
    assert flipped == rows.where("malicious = 1").count() > 0
    assert rows.where("malicious = 0 AND train_label <> label_id").count() == 0


def test_raw_weight_equals_examples_without_rebalancing(spark, sets):
    """Without oversampling the post-oversampling count is the raw count: identical logs."""
    tr, va, te, nf, nc = sets
    base = dict(rounds=1, rebalance="none", partition_alpha=0.5)
    a = FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(**base, run_name="ex")).collect()
    b = FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(**base, weight="raw", run_name="raw")).collect()
    for x, y in zip(a, b):
        assert x["accuracy"] == y["accuracy"] and x["loss"] == pytest.approx(y["loss"], rel=1e-12)
        assert (x["train_loss"] is None and y["train_loss"] is None) or x["train_loss"] == pytest.approx(y["train_loss"])
    with pytest.raises(ValueError):
        FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(rounds=1, weight="rows"))


def test_unknown_run_options_raise_before_any_job(spark, sets):
    tr, va, te, nf, nc = sets
    for bad in (dict(aggregation="mean"), dict(attack="noise"), dict(rebalance="smote")):
        with pytest.raises(ValueError):
            FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(rounds=1, **bad))


def test_clean_run_ignores_configured_malicious_fraction(spark, sets):
    """attack='none': logged fraction 0 and defence f = 0, so Multi-Krum keeps every client."""
    tr, va, te, nf, nc = sets
    cfg = FD.RunConfig(rounds=1, aggregation="multikrum", attack="none", malicious_fraction=0.4, run_name="c")
    log = FD.run_federated(spark, tr, te, va, nf, nc, cfg).collect()
    assert all(r["malicious_fraction"] == 0.0 for r in log)
    assert log[1]["kept_clients"] == 5 and log[1]["malicious_in_round"] == 0


def test_run_labels_tell_runs_apart():
    names = {FD.RunConfig(aggregation=a, attack=t, malicious_fraction=f, seed=s, partition_alpha=p).label()
             for a in ("fedavg", "krum") for t, f in (("none", 0.0), ("label_flip", 0.1), ("label_flip", 0.2)) for s in (1, 2) for p in (0.0, 0.5)}
    assert len(names) == 24 and FD.RunConfig(run_name="x").label() == "x"


def test_log_holds_the_rounds_of_a_run_that_stops(spark, sets, monkeypatch):
    """Each round is written when it ends; a rerun replaces the log of its own run only."""
    tr, va, te, nf, nc = sets
    d = tempfile.mkdtemp(prefix="rampart-log-")
    cfg = FD.RunConfig(rounds=3, local_epochs=1, n_silos=3, run_name="a")
    train, calls = FD.train_local, []

    def failing(*args, **kw):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return train(*args, **kw)

    monkeypatch.setattr(FD, "train_local", failing)
    with pytest.raises(RuntimeError, match="lost"):
        FD.run_federated(spark, tr, te, va, nf, nc, cfg, d)
    assert sorted(r["round"] for r in spark.read.parquet(d).collect()) == [0, 1, 2]
    monkeypatch.setattr(FD, "train_local", train)
    FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(rounds=1, local_epochs=1, n_silos=3, run_name="a"), d)
    FD.run_federated(spark, tr, te, va, nf, nc, FD.RunConfig(rounds=1, local_epochs=1, n_silos=3, run_name="b"), d)
    assert sorted((r["run_name"], r["round"]) for r in spark.read.parquet(d).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_one_pass_scores_and_takes_gradients(spark, sets):
    """The fused pass equals the scoring pass and the gradient pass, also for a binary model."""
    import numpy as np
    from pyspark.sql import functions as F

    from rampart.operators import model as MD

    tr, va, te, nf, nc = sets
    rng = np.random.default_rng(3)
    for classes in (nc, 2):
        binary = lambda d: d.withColumn("label_id", F.least("label_id", F.lit(classes - 1)))
        a, b, c = binary(tr), binary(te), binary(va)
        rows = a.withColumn("silo_id", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int")).withColumn("train_label", F.col("label_id")) \
            .withColumn("w_row", F.lit(1.5)).withColumn("part", F.when(F.rand(1) < 0.9, "train").otherwise("val"))
        m = MD.LinearModel.zeros(nf, classes)
        m = MD.LinearModel.from_flat(rng.standard_normal(m.flat().size), nf, classes)
        both = FD._with_sets(rows, b, c)
        first, told = MD.evaluated_gradients(both, m, [0, 1, 2], nf, ["test", "val"], weight="w_row")
        want = MD.gradients(both.where("part = 'train'"), {s: m for s in range(3)}, nf, weight="w_row")
        assert sorted(first) == [0, 1, 2] and all(np.allclose(first[s][2], want[s][2]) and np.allclose(first[s][:2], want[s][:2]) for s in first)
        got, one = FD._metric_columns(told), FD.evaluate(m, b, c)
        assert got.keys() == one.keys() and all(abs(got[k] - one[k]) < 1e-9 for k in one)
