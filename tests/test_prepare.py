"""Preparation from split tables (generator as in the reference test: 3 classes, constant column)."""

import os
import tempfile

import numpy as np
import pytest

from rampart.plans.prepare import prepare_from_splits


def _write(d, leaky=False):
    rng = np.random.default_rng(0)
    labels = ["BENIGN", "DoS", "PortScan"]
    start = 0
    for name, n in (("train", 300), ("validation", 100), ("test", 100)):
        ids = np.arange(n) if (leaky and name != "train") else np.arange(start, start + n)
        start += n
        with open(os.path.join(d, f"{name}_group_aware.csv"), "w") as fh:
            fh.write("Row_ID, a,b,c,d, k,Label\n")
            for i in ids:
                a, b, c, dd = rng.normal(size=4) * [1, 10, 100, 1000]
                fh.write(f"{i},{a},{b},{c},{dd},7.0, {labels[i % 3]}\n")


@pytest.fixture()
def split_dir():
    d = tempfile.mkdtemp(prefix="rampart-splits-")
    _write(d)
    return d


def test_prepare_end_to_end(spark, split_dir):
    out = tempfile.mkdtemp(prefix="rampart-store-")
    res = prepare_from_splits(spark, split_dir, out=os.path.join(out, "s"))
    assert res.features == ["a", "b", "c", "d"] and res.meta["dropped_constant"] == ["k"]
    train = res.rows.where("split = 'train'")
    assert train.count() == 300
    x = np.array([r["features"] for r in train.collect()])
    assert x.shape == (300, 4) and np.all(np.abs(x.mean(axis=0)) < 1e-3)
    assert res.n_classes == 3 and res.meta["class_map"]["BENIGN"] == 0


def test_binary_labels(spark, split_dir):
    res = prepare_from_splits(spark, split_dir, label_mode="binary")
    assert {r["label_id"] for r in res.rows.select("label_id").distinct().collect()} == {0, 1}


def test_leaky_ids_raise(spark):
    d = tempfile.mkdtemp(prefix="rampart-leak-")
    _write(d, leaky=True)
    with pytest.raises(ValueError, match="leak"):
        prepare_from_splits(spark, d)


def test_missing_split_raises(spark):
    with pytest.raises(FileNotFoundError):
        prepare_from_splits(spark, tempfile.mkdtemp(prefix="rampart-empty-"))


def test_no_benign_raises_in_both_modes(spark):
    d = tempfile.mkdtemp(prefix="rampart-nobenign-")
    for name in ("train", "validation", "test"):
        with open(os.path.join(d, f"{name}_group_aware.csv"), "w") as fh:
            fh.write("Row_ID,a,Label\n")
            base = {"train": 0, "validation": 100, "test": 200}[name]
            for i in range(base, base + 10):
                fh.write(f"{i},{i * 0.5},{'DoS' if i % 2 else 'PortScan'}\n")
    for mode in ("multiclass", "binary"):
        with pytest.raises(ValueError, match="BENIGN"):
            prepare_from_splits(spark, d, label_mode=mode)
