"""Registered queries: hash ranks, samples, splits and silo partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import features as FE
from rampart.operators import sampling as S
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import FLOWS_ENC, LABEL_MAP, key, unit_of
from rampart.sources import tables as T

N_SILOS = 5
DIRICHLET_ALPHA = 0.5
SEED = 42


def encoded_flows(spark, sf):
    fl = T.flows(spark, sf)
    return FE.encode_labels(fl, FE.label_map(fl))


def proportions():
    return S.dirichlet_proportions(5, N_SILOS, DIRICHLET_ALPHA, SEED)


def iid(spark, sf):
    return S.iid_partition(encoded_flows(spark, sf), "row_id", N_SILOS, SEED)


def dirichlet(spark, sf):
    return S.dirichlet_partition(encoded_flows(spark, sf), "row_id", proportions(), seed=SEED)


def q_rank(spark, sf):
    return S.hash_rank(T.flows(spark, sf), "row_id", SEED, size_col=None).select("row_id", "rank")


def q_strat_min(spark, sf):
    return S.stratified_sample_min(T.flows(spark, sf), "row_id", "label", 0.1, 20, SEED).select("row_id", "label")


def q_strat_frac(spark, sf):
    return S.stratified_sample_frac(T.splits(spark, sf), "row_id", "label", 0.3, SEED, ["split"]).select(
        "row_id", "split", "label")


def q_uniform(spark, sf):
    return S.uniform_sample(T.flows(spark, sf), "row_id", 1000, SEED).select("row_id")


def equal_rows(spark, sf):
    """Rows of three columns of few values: most are equal to many others."""
    d = encoded_flows(spark, sf).select((F.col("row_id") % 7).alias("id"), "label_id", F.lit(0).alias("one"))
    return d.withColumn("id", F.when(F.col("id") > 0, F.col("id")))  # a seventh has no id


def q_equal_uniform(spark, sf):
    """How many of the equal rows a fixed-size sample keeps: exactly as many as asked."""
    return S.uniform_sample(equal_rows(spark, sf), "id", 1003, SEED).agg(F.count("*").alias("n"))


def q_equal_iid(spark, sf):
    """Silo sizes over equal rows: they differ by one at most."""
    return S.iid_partition(equal_rows(spark, sf), "id", N_SILOS, SEED).groupBy("silo_id").agg(F.count("*").alias("n"))


def q_equal_undersample(spark, sf):
    u = S.undersample_benign(equal_rows(spark, sf), "id", ratio=0.37, seed=SEED)
    return u.groupBy("label_id").agg(F.count("*").alias("n"))


def q_equal_val_split(spark, sf):
    d = S.dirichlet_partition(equal_rows(spark, sf), "id", proportions(), seed=SEED)
    return S.silo_validation_split(d, "id", seed=f"{SEED}:val").groupBy("silo_id", "part").agg(F.count("*").alias("n"))


def _oversampled_counts(rows, id_col):
    d = S.dirichlet_partition(rows, id_col, proportions(), seed=SEED)
    o = S.random_oversample(d, id_col, seed=f"{SEED}:over")
    return o.groupBy("silo_id", "label_id").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 0).alias("originals"))


def q_oversample_repeated(spark, sf):
    """Ids that 50 rows share."""
    return _oversampled_counts(encoded_flows(spark, sf).withColumn("id", F.floor(F.col("row_id") / 50)), "id")


def q_oversample_null(spark, sf):
    """A third of the rows has no id, and equal rows abound."""
    return _oversampled_counts(equal_rows(spark, sf).withColumn("id", F.when(F.col("id") > 2, F.col("id"))), "id")


def q_uniform_repeated(spark, sf):
    """Ids that 50 rows share: 20 whole ids make the sample."""
    d = T.flows(spark, sf).withColumn("id", F.floor(F.col("row_id") / 50))
    return S.uniform_sample(d.select("id", "row_id"), "id", 1000, SEED)


def q_strat_split(spark, sf):
    fl = T.flows(spark, sf).withColumn("is_attack", FE.is_attack_label("label"))
    return S.stratified_split(fl, "row_id", "label", 0.2, SEED).select("row_id", "split")


def q_group_split(spark, sf):
    return S.group_aware_split(T.splits(spark, sf).drop("split"), "feats").select("row_id", "split")


def q_undersample(spark, sf):
    return S.undersample_benign(encoded_flows(spark, sf), "row_id", ratio=3.0, seed=SEED).select("row_id", "label_id")


def q_undersample_02(spark, sf):
    return S.undersample_benign(encoded_flows(spark, sf), "row_id", ratio=0.2, seed=SEED).select("row_id", "label_id")


def q_iid(spark, sf):
    return iid(spark, sf).select("row_id", "silo_id")


def q_dirichlet(spark, sf):
    return dirichlet(spark, sf).select("row_id", "label_id", "silo_id")


def q_val_split(spark, sf):
    return S.silo_validation_split(iid(spark, sf), "row_id", seed=f"{SEED}:val").select("row_id", "silo_id", "part")


def q_over_weights(spark, sf):
    w = S.oversample_weights(dirichlet(spark, sf))
    return w.select("silo_id", "label_id", "cnt", "target", F.round("weight", 6).alias("weight"))


def q_oversample(spark, sf):
    o = S.random_oversample(dirichlet(spark, sf), "row_id", seed=f"{SEED}:over")
    return o.select("silo_id", "label_id", "row_id", "copy")


QUERIES = {
    "sampling_hash_rank": q_rank,
    "sampling_stratified_min": q_strat_min,
    "sampling_stratified_frac": q_strat_frac,
    "sampling_uniform": q_uniform,
    "sampling_uniform_repeated_ids": q_uniform_repeated,
    "sampling_stratified_split": q_strat_split,
    "sampling_group_aware_split": q_group_split,
    "sampling_undersample": q_undersample,
    "sampling_undersample_ratio02": q_undersample_02,
    "silo_iid_partition": q_iid,
    "silo_dirichlet_partition": q_dirichlet,
    "silo_validation_split": q_val_split,
    "silo_oversample_weights": q_over_weights,
    "silo_oversample": q_oversample,
    "silo_oversample_repeated_ids": q_oversample_repeated,
    "silo_oversample_null_ids": q_oversample_null,
    "sampling_uniform_equal_rows": q_equal_uniform,
    "sampling_undersample_equal_rows": q_equal_undersample,
    "silo_iid_equal_rows": q_equal_iid,
    "silo_validation_equal_rows": q_equal_val_split,
}


def _rank_sql(src: str, seed, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {key('row_id', seed)}, row_id)"


_IID = ("iid", f"""
SELECT row_id, label_id, CAST(CASE WHEN rk - 1 < (n % {N_SILOS}) * (n // {N_SILOS} + 1)
                         THEN (rk - 1) // (n // {N_SILOS} + 1)
                         ELSE (n % {N_SILOS}) + (rk - 1 - (n % {N_SILOS}) * (n // {N_SILOS} + 1)) // (n // {N_SILOS})
                    END AS INTEGER) AS silo_id
FROM (SELECT row_id, label_id, {_rank_sql('fl', SEED)} AS rk, count(*) OVER () AS n FROM fl) r""")


def _cuts_sql(props=None) -> tuple[str, str]:
    import numpy as np

    rows = []
    by = {}
    for c, s, p in (props if props is not None else proportions()):
        by.setdefault(c, []).append(p)
    for c, ps in by.items():
        cum = np.cumsum(ps)
        for s in range(len(ps)):
            lo = float(cum[s - 1]) if s else 0.0
            rows.append(f"({c}, {s}, {lo!r}, {float(cum[s])!r}, {len(ps) - 1})")
    return ("cuts", "SELECT * FROM (VALUES " + ", ".join(rows) + ") t(label_id, silo_id, cum_lo, cum_hi, last_silo)")


_DIR = ("dir", f"""
SELECT r.row_id, r.label_id, CAST(c.silo_id AS INTEGER) AS silo_id
FROM (SELECT row_id, label_id, {_rank_sql('fl', SEED, 'label_id')} AS rk, count(*) OVER (PARTITION BY label_id) AS n
      FROM fl) r
JOIN cuts c ON r.label_id = c.label_id
 AND r.rk > CASE WHEN c.silo_id = 0 THEN 0 ELSE floor(c.cum_lo * r.n) END
 AND r.rk <= CASE WHEN c.silo_id = c.last_silo THEN r.n ELSE floor(c.cum_hi * r.n) END""")

# how many rows of a class each silo gets needs no id: classes are cut at floor(share * n)
_CUT = ("cut", """
SELECT c.silo_id, c.label_id
FROM (SELECT c.silo_id, n.label_id, CAST(CASE WHEN c.silo_id = c.last_silo THEN n ELSE floor(c.cum_hi * n) END AS BIGINT)
        - CAST(CASE WHEN c.silo_id = 0 THEN 0 ELSE floor(c.cum_lo * n) END AS BIGINT) AS k
      FROM (SELECT label_id, count(*) AS n FROM fl GROUP BY label_id) n JOIN cuts c USING (label_id)) c,
     unnest(range(c.k)) u""")


def _over_sql(src: str, id_col: str) -> list[tuple[str, str]]:
    """Poisson offers of every row and the place of each in its class's hash order."""
    over = f"{SEED}:over"
    u, v = unit_of(key(id_col, f"{over}:k")), unit_of(key(id_col, f"{over}:z"))
    return [
        ("need", f"""SELECT *, (extra + 6.0e0 * sqrt(CAST(extra AS DOUBLE)) + 20.0e0) / cnt AS rate FROM (
  SELECT silo_id, label_id, cnt, max(cnt) OVER (PARTITION BY silo_id) - cnt AS extra
  FROM (SELECT silo_id, label_id, count(*) AS cnt FROM {src} GROUP BY 1, 2) a) b WHERE extra > 0"""),
        ("terms", """SELECT silo_id, label_id, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1.0e0))) OVER (PARTITION BY silo_id, label_id ORDER BY i) AS cdf
FROM need, (SELECT unnest(range(100)) AS i) r WHERE rate < 32"""),
        ("draws", f"""SELECT d.silo_id, d.label_id, d.{id_col}, n.cnt, n.extra, CAST(CASE
    WHEN n.rate < 32 THEN (SELECT count(*) FROM terms t WHERE t.silo_id = d.silo_id AND t.label_id = d.label_id AND t.cdf <= {u.replace(id_col, 'd.' + id_col)})
    ELSE greatest(0.0e0, floor(n.rate + sqrt(n.rate) * sqrt(-2.0e0 * ln(greatest({u.replace(id_col, 'd.' + id_col)}, 1e-18))) * cos(2.0e0 * pi() * {v.replace(id_col, 'd.' + id_col)}) + 0.5e0))
  END AS BIGINT) AS k FROM {src} d JOIN need n USING (silo_id, label_id)"""),
        ("offers", f"""SELECT silo_id, label_id, {id_col}, extra, unnest(generate_series(1, k + more)) AS copy FROM (
  SELECT *, CAST(ceil(greatest(0, extra - sum(k) OVER (PARTITION BY silo_id, label_id)) / cnt) AS BIGINT) AS more FROM draws) x"""),
        ("kept", f"""SELECT *, row_number() OVER (PARTITION BY silo_id, label_id
  ORDER BY md5({id_col} || '#' || copy || ':{over}:keep'), {id_col} || '#' || copy) AS rk FROM offers"""),
    ]


_ENC = [LABEL_MAP, FLOWS_ENC]

ORACLE = {
    "sampling_hash_rank": with_fixtures("flows", f"SELECT row_id, {_rank_sql('flows', SEED)} AS rank FROM flows"),
    "sampling_stratified_min": with_fixtures("flows", f"""
SELECT row_id, label FROM (SELECT row_id, label, {_rank_sql('flows', SEED, 'label')} AS rk,
                                  count(*) OVER (PARTITION BY label) AS n FROM flows) r
WHERE rk <= least(n, greatest(round_even(n * 0.1e0, 0), 20))"""),
    "sampling_stratified_frac": with_fixtures("splits", f"""
SELECT row_id, split, label FROM (SELECT row_id, split, label, {_rank_sql('splits', SEED, 'split, label')} AS rk,
                                         count(*) OVER (PARTITION BY split, label) AS n FROM splits) r
WHERE rk <= greatest(1, round_even(n * 0.3e0, 0))"""),
    "sampling_uniform": with_fixtures("flows", f"""
SELECT row_id FROM (SELECT row_id, {_rank_sql('flows', SEED)} AS rk FROM flows) r WHERE rk <= 1000"""),
    "sampling_uniform_repeated_ids": with_fixtures("flows", f"""
SELECT f.row_id // 50 AS id, f.row_id FROM flows f JOIN (
  SELECT id, coalesce(sum(n) OVER (ORDER BY {key('id', SEED)}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT row_id // 50 AS id, count(*) AS n FROM flows GROUP BY 1) c) r ON r.id = f.row_id // 50
WHERE r.before < 1000"""),
    "sampling_stratified_split": with_fixtures("flows", f"""
SELECT row_id, CASE WHEN rk <= round_even(n * 0.2e0, 0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT row_id, {_rank_sql('flows', SEED, 'label')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM flows) r"""),
    "sampling_group_aware_split": with_fixtures("splits", f"""
SELECT row_id, CASE WHEN {unit_of('md5(feats)')} < 0.6e0 THEN 'train'
                    WHEN {unit_of('md5(feats)')} < 0.8e0 THEN 'val' ELSE 'test' END AS split FROM splits"""),
    "sampling_undersample": with_fixtures("flows", f"""
SELECT row_id, label_id FROM fl WHERE label_id <> 0
UNION ALL
SELECT row_id, label_id FROM (SELECT row_id, label_id, {_rank_sql('fl', SEED)} AS rk FROM fl WHERE label_id = 0) b
WHERE rk <= floor(3.0e0 * (SELECT count(*) FROM fl WHERE label_id <> 0))""", _ENC),
    "sampling_undersample_ratio02": with_fixtures("flows", f"""
SELECT row_id, label_id FROM fl WHERE label_id <> 0
UNION ALL
SELECT row_id, label_id FROM (SELECT row_id, label_id, {_rank_sql('fl', SEED)} AS rk FROM fl WHERE label_id = 0) b
WHERE rk <= floor(0.2e0 * (SELECT count(*) FROM fl WHERE label_id <> 0))""", _ENC),
    "silo_iid_partition": with_fixtures("flows", "SELECT row_id, silo_id FROM iid", _ENC + [_IID]),
    "silo_dirichlet_partition": with_fixtures("flows", "SELECT row_id, label_id, silo_id FROM dir",
                                              _ENC + [_cuts_sql(), _DIR]),
    "silo_validation_split": with_fixtures("flows", f"""
SELECT row_id, silo_id, CASE WHEN rk <= greatest(1, floor(n * 0.2e0)) THEN 'val' ELSE 'train' END AS part
FROM (SELECT row_id, silo_id, {_rank_sql('iid', f'{SEED}:val', 'silo_id')} AS rk,
             count(*) OVER (PARTITION BY silo_id) AS n FROM iid) r""", _ENC + [_IID]),
    "silo_oversample_weights": with_fixtures("flows", """
SELECT silo_id, label_id, cnt, target, round(CAST(target AS DOUBLE) / cnt, 6) AS weight
FROM (SELECT silo_id, label_id, count(*) AS cnt, max(count(*)) OVER (PARTITION BY silo_id) AS target
      FROM dir GROUP BY silo_id, label_id) c""", _ENC + [_cuts_sql(), _DIR]),
    "silo_oversample": with_fixtures("flows", """
SELECT silo_id, label_id, row_id, CAST(0 AS BIGINT) AS copy FROM dir
UNION ALL
SELECT silo_id, label_id, row_id, copy FROM kept WHERE rk <= extra""", _ENC + [_cuts_sql(), _DIR, *_over_sql("dir", "row_id")]),
    # every class of a silo has the count of its largest, whatever the ids
    **{f"silo_oversample_{k}_ids": with_fixtures("flows", """
SELECT silo_id, label_id, max(n) OVER (PARTITION BY silo_id) AS n, n AS originals
FROM (SELECT silo_id, label_id, count(*) AS n FROM cut GROUP BY 1, 2) c""", _ENC + [_cuts_sql(), _CUT]) for k in ("repeated", "null")},
    "sampling_uniform_equal_rows": with_fixtures("flows", "SELECT least(1003, count(*)) AS n FROM flows"),
    "sampling_undersample_equal_rows": with_fixtures("flows", """
SELECT label_id, CASE WHEN label_id = 0 THEN least(n, CAST(floor(0.37e0 * (sum(n) FILTER (WHERE label_id <> 0) OVER ())) AS BIGINT)) ELSE n END AS n
FROM (SELECT label_id, count(*) AS n FROM fl GROUP BY label_id) c""", _ENC),
    "silo_iid_equal_rows": with_fixtures("flows", f"""
SELECT CAST(s AS INTEGER) AS silo_id, n // {N_SILOS} + CASE WHEN s < n % {N_SILOS} THEN 1 ELSE 0 END AS n
FROM (SELECT count(*) AS n FROM flows) c, (SELECT unnest(range({N_SILOS})) AS s) r"""),
    "silo_validation_equal_rows": with_fixtures("flows", """
SELECT silo_id, part, CAST(CASE WHEN part = 'val' THEN v ELSE n - v END AS BIGINT) AS n
FROM (SELECT silo_id, n, greatest(1, floor(n * 0.2e0)) AS v FROM (SELECT silo_id, count(*) AS n FROM cut GROUP BY 1) c) s,
     (VALUES ('val'), ('train')) p(part)
WHERE CASE WHEN part = 'val' THEN v ELSE n - v END > 0""", _ENC + [_cuts_sql(), _CUT]),
}
