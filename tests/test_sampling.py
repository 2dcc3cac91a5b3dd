"""Hash ranks, samples, splits and silo partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rampart.functions.scalar import hash_key
from rampart.operators import rank as R
from rampart.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(F.col("id").alias("row_id"),
                                    (F.col("id") % 7 == 0).cast("int").alias("label_id")).cache()


@pytest.mark.parametrize("bucket_hex", [1, 2, 3])
def test_two_phase_rank_equals_global_rank(rows, bucket_hex):
    r = S.hash_rank(rows, "row_id", 42, bucket_hex=bucket_hex, size_col=None)
    ref = rows.withColumn("ref", F.row_number().over(Window.orderBy(hash_key("row_id", 42), "row_id")))
    bad = r.join(ref, "row_id").where(F.col("rank") != F.col("ref")).count()
    assert bad == 0


def test_stratified_rank_equals_window(rows):
    r = S.hash_rank(rows, "row_id", 7, ["label_id"])
    w = Window.partitionBy("label_id").orderBy(hash_key("row_id", 7), "row_id")
    ref = rows.withColumn("ref", F.row_number().over(w))
    assert r.join(ref, ["row_id", "label_id"]).where(F.col("rank") != F.col("ref")).count() == 0


def test_iid_partition_sizes(rows):
    sizes = sorted((r["silo_id"], r["count"]) for r in S.iid_partition(rows, "row_id", 7).groupBy("silo_id").count().collect())
    counts = [c for _, c in sizes]
    assert sum(counts) == 3000 and max(counts) - min(counts) <= 1 and counts == sorted(counts, reverse=True)


def test_dirichlet_partition_assigns_every_row_once(rows):
    props = S.dirichlet_proportions(2, 4, 0.5, 42)
    p = S.dirichlet_partition(rows, "row_id", props)
    assert p.count() == 3000 and p.select("row_id").distinct().count() == 3000
    # per class the sizes follow floor(cumsum(p) * n)
    import numpy as np
    n0 = rows.where("label_id = 0").count()
    cum = np.cumsum([x for c, s, x in props if c == 0])
    cuts = [0] + [int(v) for v in (cum * n0)[:-1]] + [n0]
    got = {r["silo_id"]: r["count"] for r in p.where("label_id = 0").groupBy("silo_id").count().collect()}
    assert [got.get(s, 0) for s in range(4)] == list(np.diff(cuts))


def test_dirichlet_retries_until_min_rows():
    props = S.dirichlet_proportions(2, 3, 100.0, 1, class_counts={0: 600, 1: 600}, min_rows=100)
    assert len(props) == 6 and abs(sum(p for c, s, p in props if c == 0) - 1) < 1e-9


def test_oversample_like_reference(spark):
    df = spark.createDataFrame([(i, 0 if i < 80 else 1, 0) for i in range(100)], "row_id long, label_id int, silo_id int")
    part = S.silo_validation_split(df, "row_id", val_fraction=0.01)
    assert part.where("part = 'val'").count() == 1
    train = part.where("part = 'train'")
    over = S.random_oversample(train, "row_id")
    counts = {r["label_id"]: r["count"] for r in over.groupBy("label_id").count().collect()}
    assert counts[0] == counts[1] and sum(counts.values()) > 99
    w = {r["label_id"]: r["weight"] for r in S.oversample_weights(train).collect()}
    assert w[0] == 1.0 and w[1] > 1.0


def test_stratified_samples(rows):
    a = S.stratified_sample_min(rows, "row_id", "label_id", 0.01, 20)
    got = {r["label_id"]: r["count"] for r in a.groupBy("label_id").count().collect()}
    assert got == {0: 26, 1: 20}
    b = S.stratified_sample_frac(rows, "row_id", "label_id", 0.1)
    got = {r["label_id"]: r["count"] for r in b.groupBy("label_id").count().collect()}
    assert got == {0: 257, 1: 43}


def test_group_aware_split_keeps_copies_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(500)], "row_id long, feats string")
    s = S.group_aware_split(df, "feats")
    assert s.groupBy("feats").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_undersample(rows):
    u = S.undersample_benign(rows.withColumn("label_id", 1 - F.col("label_id")), "row_id", ratio=1.0)
    # attacks = 429 (multiples of 7 -> label 0 after the flip are benign ... ) keep min(benign, attacks)
    counts = {r["label_id"]: r["count"] for r in u.groupBy("label_id").count().collect()}
    assert counts[0] == min(429, counts[1])


def test_rank_keeps_null_strata(spark):
    """A NULL stratum is ranked as its own group, exactly like a window partition."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = [(i, None if i % 7 == 0 else f"c{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, label string")
    got = {r["row_id"]: (r["rank"], r["stratum_size"]) for r in S.hash_rank(df, "row_id", 42, ["label"]).collect()}
    key = F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":42")))
    w = Window.partitionBy("label").orderBy(key, "row_id")
    want = {r["row_id"]: (r["rank"], r["n"]) for r in df.select(
        "row_id", F.row_number().over(w).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n")
    ).collect()}
    assert got == want and len(got) == 500


@pytest.mark.parametrize("leaf", [16_384, 100, 3])
def test_rank_cutoffs_equal_exact_ranks(spark, monkeypatch, leaf):
    """rank_tag (cutoffs, no per-row rank) equals the exact rank: NULL strata, several tags per
    stratum, coarse buckets holding many targets, no strata, and a target past the stratum's end."""
    monkeypatch.setattr(R, "LEAF_ROWS", leaf)  # how far the buckets are refined changes no result
    rows = [(i, None if i % 7 == 0 else f"c{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, label string")

    def quarters(sizes):
        ends = F.array(*[F.struct(F.lit(s).alias("t"), F.ceil(F.col("_size") * (s + 1) / 4).alias("r")) for s in range(4)])
        return sizes.select("*", F.explode(ends).alias("_x")).select(
            "*", F.col("_x.t").alias("_tag"), F.col("_x.r").alias("_r")).drop("_x")

    got = {r["row_id"]: r["q"] for r in S.rank_tag(df, "row_id", 42, ["label"], quarters, "q").collect()}
    ref = S.hash_rank(df, "row_id", 42, ["label"]).collect()
    want = {r["row_id"]: min(s for s in range(4) if r["rank"] <= -(-r["stratum_size"] * (s + 1) // 4)) for r in ref}
    assert got == want
    every = S.first_n(df, "row_id", 42, ["label"], lambda size: size + 5)
    assert every.count() == 2000
    top = {r["row_id"] for r in S.first_n(df, "row_id", 9, [], lambda size: F.lit(37)).collect()}
    exact = {r["row_id"] for r in S.hash_rank(df, "row_id", 9).where("rank <= 37").collect()}
    assert top == exact and len(top) == 37


def test_dirichlet_with_empty_silos_matches_rank_rule(spark):
    """Zero proportions give several silos the same cut rank: rows still land in the unique silo
    whose (previous cut, cut] range holds their rank."""
    df = spark.createDataFrame([(i, i % 3) for i in range(600)], "row_id long, label_id int")
    props = [(c, s, p) for c in range(3) for s, p in enumerate([0.5, 0.0, 0.0, 0.5])]
    got = {r["row_id"]: r["silo_id"] for r in S.dirichlet_partition(df, "row_id", props, seed=3).collect()}
    ranked = S.hash_rank(df, "row_id", 3, ["label_id"]).collect()
    want = {r["row_id"]: (0 if r["rank"] <= r["stratum_size"] // 2 else 3) for r in ranked}
    assert got == want


def test_null_and_repeated_ids(spark):
    """Rows with NULL ids are ranked; rows that repeat an id are told apart by their content, so
    a sample has its exact size; nothing depends on how far buckets are refined."""
    rows = [(i // 50, i) for i in range(100)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, x long")
    assert S.uniform_sample(df, "row_id", 10).count() == 10
    assert S.uniform_sample(df, "row_id", 77).count() == 77
    assert sorted(r["rank"] for r in S.hash_rank(df, "row_id", 1).collect()) == list(range(1, 131))
    top = {(r.row_id, r.x) for r in S.uniform_sample(df, "row_id", 60, 1).collect()}
    assert top == {(r.row_id, r.x) for r in S.hash_rank(df, "row_id", 1).where("rank <= 60").collect()}


def test_identical_rows_are_cut_by_count(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 50, "row_id long, x string")
    assert S.uniform_sample(df, "row_id", 10).count() == 10


def test_undersample_keeps_null_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "row_id long, label_id int")
    assert S.undersample_benign(df, "row_id", ratio=5.0).count() == 3
    assert {r.row_id for r in S.undersample_benign(df, "row_id", ratio=0.1).collect()} == {2, 3}


def test_dirichlet_class_without_cuts_is_an_error(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label_id int")
    with pytest.raises(Exception, match="no silo proportions"):
        S.dirichlet_partition(df, "row_id", [(0, 0, 1.0)]).collect()


def test_oversample_spreads_the_copies_of_one_row(spark):
    """One source row picked many times: its copies come from several tasks."""
    df = spark.createDataFrame([(0, 1, 0)] + [(i, 0, 0) for i in range(1, 2001)], "row_id long, label_id int, silo_id int")
    over = S.random_oversample(df, "row_id", chunk=100)
    one = over.where("row_id = 0")
    copies = [r.copy for r in one.collect()]
    assert len(copies) == len(set(copies)) == 2000


def test_boundaries_cut_equal_rows_by_count(spark):
    """Two distinct rows, 500 times each: samples and silos have their exact sizes."""
    df = spark.createDataFrame([(1, "a", {"k": 1.5}), (2, None, None)] * 500, "row_id long, label string, m map<string,double>")
    assert S.uniform_sample(df, "row_id", 10).count() == 10
    assert sorted(r["count"] for r in S.iid_partition(df, "row_id", 4).groupBy("silo_id").count().collect()) == [250] * 4
    got = S.iid_partition(df, "row_id", 7).collect()
    assert sorted(sum(r.silo_id == s for r in got) for s in range(7)) == [142, 143, 143, 143, 143, 143, 143]
    assert sum(r.row_id == 1 and r.label == "a" and r.m == {"k": 1.5} for r in got) == 500
    by_label = S.stratified_sample_frac(df, "row_id", "label", 0.1).groupBy("label").count().collect()
    assert sorted(r["count"] for r in by_label) == [50, 50]


def test_boundaries_in_several_pieces(spark, monkeypatch):
    from rampart.operators import rank

    monkeypatch.setattr(rank, "COPY_ROWS", 7)
    df = spark.createDataFrame([(None, 1)] * 100 + [(None, 2)] * 23 + [(5, 1)], "row_id long, x int")
    got = S.iid_partition(df, "row_id", 9).collect()
    assert sorted(sum(r.silo_id == s for r in got) for s in range(9)) == [13, 13, 14, 14, 14, 14, 14, 14, 14]
    assert sorted((r.row_id or 0, r.x) for r in got) == sorted([(0, 1)] * 100 + [(0, 2)] * 23 + [(5, 1)])


def test_oversample_is_exact_for_any_ids(spark):
    """Unique, repeated and missing ids, equal rows, rows without a class, one row against many."""
    rows = [(i, 0, 0, "u") for i in range(300)] + [(i % 5, 1, 0, "r") for i in range(60)] + [(None, 2, 0, "n")] * 40 + [(7, 3, 0, "one")]
    rows += [(i, 0, 1, "u") for i in range(50)] + [(None, None, 1, "x"), (1, 0, None, "x")]
    df = spark.createDataFrame(rows, "row_id long, label_id int, silo_id int, tag string")
    got = S.random_oversample(df, "row_id", chunk=50)
    counts = {(r.silo_id, r.label_id): r["count"] for r in got.groupBy("silo_id", "label_id").count().collect()}
    assert counts == {(0, 0): 300, (0, 1): 300, (0, 2): 300, (0, 3): 300, (1, 0): 50, (1, None): 1, (None, 0): 1}
    assert sorted(map(repr, got.where("copy = 0").drop("copy").collect())) == sorted(map(repr, df.collect()))
    draws = [r["count"] for r in got.where("tag = 'r' and copy > 0").groupBy("row_id").count().collect()]
    assert sum(draws) == 240 and max(draws) < 150


def test_oversample_draws_like_a_multinomial(spark):
    """Copies of a row vary as draws with replacement do."""
    import numpy as np

    df = spark.createDataFrame([(i, int(i >= 1000), 0) for i in range(5000)], "row_id long, label_id int, silo_id int")
    k = {r.row_id: r["count"] for r in S.random_oversample(df, "row_id").where("copy > 0").groupBy("row_id").count().collect()}
    k = np.array([k.get(i, 0) for i in range(1000)])
    assert k.sum() == 3000 and abs(k.var() - 3) < 0.5 and (k == 0).mean() > 0.02


def test_draws_hash_a_row_once(spark):
    """The hashes stand outside the filter over the cumulative terms, which would work them out a term."""
    df = spark.range(10).withColumn("_rate", F.lit(2.0)).withColumn("_cdf", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    plan = df.select(S._poisson_draw("id", "s").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    body = plan[plan.index("filter("):]
    assert "md5" in plan and "md5" not in body[:body.index(" <= ") + 80]


def test_boundary_search_ends_at_a_bucket_of_one_key(spark, monkeypatch):
    """Rows without an id share one key, so finer buckets hold as many rows."""
    monkeypatch.setattr(R, "LEAF_ROWS", 20)
    df = spark.range(300).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("v"))
    keyed, sk = R.stratum_keys(df, [])
    keyed = keyed.withColumn("_key", R._key("id", 7))
    target = spark.createDataFrame([(0, 100, 300)], "_tag int, _r long, _size long")
    active, digits = R._boundaries(keyed, sk, target)
    assert digits == R._STEP and [(r["_tag"], r["_r"]) for r in active.collect()] == [(0, 100)]
    got = S.uniform_sample(df, "id", 100, 7).count()
    assert got == 100
