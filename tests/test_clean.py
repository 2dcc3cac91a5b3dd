"""Cleaning helpers and the exact distributed quantiles."""

import numpy as np
import pytest

from rampart.operators import clean as C


@pytest.mark.parametrize("max_sort_rows", [1_000_000, 10])
def test_exact_quantiles_match_numpy(spark, max_sort_rows):
    rng = np.random.default_rng(3)
    a = rng.normal(size=5000)
    b = np.round(rng.exponential(size=5000), 1)          # heavy ties
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in
           C.exact_quantiles(df, ["a", "b"], buckets=16, max_sort_rows=max_sort_rows).collect()}
    for col, arr in (("a", a), ("b", b)):
        for p in (0.25, 0.5, 0.75):
            assert got[(col, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-12)


def test_nonfinite_count(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (float("nan"), None), (2.0, 3.0)], "x double, y double")
    out, cnt = C.zero_nonfinite_with_count(df, ["x", "y"])
    assert cnt.head()["n_replaced"] == 3
    assert sorted(tuple(r) for r in out.collect()) == [(0.0, 0.0), (1.0, 0.0), (2.0, 3.0)]


def test_top_values_counts_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("b",), ("b",), ("b",)], "x string")
    assert [(r["x"], r["n"]) for r in C.top_values(df, "x", 2).collect()] == [("b", 3), (None, 2)]
