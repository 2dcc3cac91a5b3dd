"""Scalar subqueries, generator grids and bounded dictionary joins."""

from pyspark.sql import functions as F

from rampart.functions.attach import expand_values, lookup_join, scalar_row, small_table, with_scalars


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_with_scalars_attaches_one_row_without_a_join(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("mx"))
    out = with_scalars(df, tot)
    assert {(r["n"], r["mx"]) for r in out.collect()} == {(10, 9)}
    plan = _plan(out)
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_scalar_row_and_empty_aggregate(spark):
    a = spark.range(5).agg(F.count(F.lit(1)).alias("a"))
    b = spark.range(0).agg(F.max("id").alias("b"))
    r = scalar_row(a, b).collect()
    assert len(r) == 1 and r[0]["a"] == 5 and r[0]["b"] is None


def test_expand_values_copies_every_row(spark):
    out = expand_values(spark.range(3), "f", [0.1, 0.2], "double")
    assert sorted((r["id"], r["f"]) for r in out.collect()) == [(i, f) for i in range(3) for f in (0.1, 0.2)]


def test_lookup_join_broadcasts_within_bound_and_shuffles_beyond(spark):
    rows = spark.createDataFrame([(i, "A" if i % 4 else "B") for i in range(40)], "id long, k string")
    dic = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    small = lookup_join(rows, dic, "k")
    assert "BroadcastHashJoin" in _plan(small)
    big = lookup_join(rows, dic, "k", max_rows=1)          # beyond the bound: plain join
    want = sorted((i, 1 if i % 4 else 2) for i in range(40))
    assert sorted((r["id"], r["v"]) for r in small.collect()) == want
    assert sorted((r["id"], r["v"]) for r in big.collect()) == want
    assert small_table(dic, max_rows=1) is None and small_table(dic).count() == 2
