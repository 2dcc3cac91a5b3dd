"""Raw CSVs to the feature store, end to end."""

import os
import tempfile

import numpy as np
import pytest

from rampart.plans.prepare_raw import prepare_from_raw
from rampart.sources import io as IO


def _write(d):
    """Two day files (one with a repeated column), a constant, a near copy, bad cells, repeats."""
    rng = np.random.default_rng(1)
    labels = ["BENIGN", "DoS – Hulk", "PortScan"]
    for day, n in enumerate((400, 300)):
        with open(os.path.join(d, f"day{day}.csv"), "w", encoding="latin-1", errors="replace") as fh:
            fh.write(" a, b,c,copy, k, Label\n" if day else " a, b,c,copy, k,a.1, Label\n")
            for i in range(n):
                a, b, c = rng.normal(size=3) * [1, 10, 100]
                cells = [a if i % 50 else "Infinity", b if i % 60 else "x", c, 3 * c + 1, 7.0] + ([] if day else [0])
                line = ",".join(map(str, cells)) + f",{labels[0 if i % 4 < 2 else i % 4 - 1]} \n"
                fh.write(line * (2 if i % 100 == 1 else 1))


@pytest.mark.parametrize("mode", ["multiclass", "binary"])
def test_prepare_from_raw(spark, mode):
    d, out = tempfile.mkdtemp(prefix="rampart-raw-"), tempfile.mkdtemp(prefix="rampart-store-")
    _write(d)
    kw = {"undersample_ratio": 0.5, "top_k": 2} if mode == "binary" else {}
    p = prepare_from_raw(spark, d, out=f"{out}/s", label_mode=mode, **kw)
    f = p.meta["funnel"]
    assert f["rows_raw"] == 700 + 7 and f["rows_bad"] == f["rows_raw"] - f["rows_after_dropna"] > 20
    assert f["rows_after_dropna"] - f["rows_dedup"] == 7
    assert p.meta["dropped_constant"] == ["k"] and p.meta["dropped_correlated"] == ["copy"]
    assert p.n_classes == (2 if mode == "binary" else 3)
    train = p.rows.where("split = 'train'")
    if mode == "multiclass":
        assert p.features == ["a", "b", "c"] and p.rows.count() == f["rows_dedup"]
        x = np.array([r["features"] for r in train.collect()])
        assert np.abs(x.mean(axis=0)).max() < 1e-3 and np.abs(x.std(axis=0) - 1).max() < 1e-3
        by = {r["label_id"]: r["n"] for r in p.rows.groupBy("label_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
        test = {r["label_id"]: r["n"] for r in p.rows.where("split = 'test'").groupBy("label_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
        assert all(abs(test[k] - 0.2 * by[k]) <= 1 for k in by)
        assert "DoS" in " ".join(p.meta["class_map"])
    else:
        assert len(p.features) == 2 and len(p.meta["dropped_low_importance"]) == 1
        n = {r["label_id"]: r["count"] for r in train.groupBy("label_id").count().collect()}
        assert n[0] == n[1] // 2
    assert IO.read_meta(spark, f"{out}/s/meta")["feature_names"] == p.features


def test_no_csv_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        prepare_from_raw(spark, tempfile.mkdtemp(prefix="rampart-none-"))
