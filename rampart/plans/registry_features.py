"""Registered queries: label encoding, transforms, scaling, feature selection profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.functions.scalar import signed_log1p
from rampart.operators import features as FE
from rampart.operators import sampling as S
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import FLOWS_ENC, LABEL_MAP, key, unit_of
from rampart.sources import tables as T

FEATS = ["f_value", "f_k", "f_hour"]
TOP_K = 25


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def split_flows(spark, sf):
    """F-flows with a row-level hash split (75 / 12.5 / 12.5)."""
    return S.hash_split(T.flows(spark, sf), "row_id", "split")


def q_label_map(spark, sf):
    return FE.label_map(T.flows(spark, sf))


def q_encoded(spark, sf):
    fl = T.flows(spark, sf)
    enc = FE.encode_labels(fl, FE.label_map(fl))
    return enc.select("row_id", "label_id", FE.is_attack_label("label").alias("is_attack"))


def q_signed_log(spark, sf):
    fl = T.flows(spark, sf)
    return fl.select("row_id", *[r6(signed_log1p(c)).alias(c) for c in FEATS])


def q_stats(spark, sf):
    fl = split_flows(spark, sf).where(F.col("split") == "train")
    s = FE.feature_stats(fl, FEATS + ["f_const"])
    return s.select("feature", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


def _scaled(spark, sf, mode):
    df = split_flows(spark, sf)
    out, kept, _ = FE.prepare_features(df, FEATS + ["f_const"], mode=mode)
    return out.select("row_id", "split", *[r6(c).alias(c) for c in kept])


def q_scaled_signedlog(spark, sf):
    return _scaled(spark, sf, "signedlog")


def q_scaled_standard(spark, sf):
    return _scaled(spark, sf, "standard")


def q_constant(spark, sf):
    return FE.constant_features(FE.feature_stats(T.flows(spark, sf), FEATS + ["f_const"]), by="range")


def q_histogram(spark, sf):
    h = FE.class_histogram(T.wide_long(spark, sf))
    return h.select("label_id", "pos", "bin", r6("density").alias("density"))


def q_corr(spark, sf):
    c = FE.correlation_matrix(T.wide(spark, sf))
    return c.select("i", "j", r6("r").alias("r"))


def q_corr_drop(spark, sf):
    return FE.correlated_drop(FE.correlation_matrix(T.wide(spark, sf)))


def q_label_corr(spark, sf):
    w = T.wide(spark, sf).withColumn("y_bin", (F.col("label_id") != 0).cast("int"))
    t = FE.top_k(FE.label_correlation_wide(w, T.N_WIDE), TOP_K)
    return t.select(F.col("rank").cast("int").alias("rank"), "pos", r6("abs_corr").alias("abs_corr"))


def q_top_matrix(spark, sf):
    w = T.wide(spark, sf).withColumn("y_bin", (F.col("label_id") != 0).cast("int"))
    return FE.top_correlation_matrix(w, T.N_WIDE, 25).select("i", "j", r6("r").alias("r"))


def planted_wide(spark, sf):
    """F-wide with a linear copy of feature 0, a noisy copy of feature 1 and a constant."""
    x = F.col("features")
    noisy = x[1] + F.lit(0.02) * x[2]
    return T.wide(spark, sf).withColumn("features", F.concat(x, F.array(x[0] * 2 + 1, noisy, F.lit(5.0))))


def q_corr_drop_planted(spark, sf):
    return FE.correlated_drop(FE.correlation_matrix(planted_wide(spark, sf)))


def q_label_corr_constant(spark, sf):
    w = planted_wide(spark, sf).withColumn("y_bin", (F.col("label_id") != 0).cast("int"))
    c = FE.label_correlation_wide(w, T.N_WIDE + 3)
    return c.select("pos", r6("abs_corr").alias("abs_corr"))


def q_forest(spark, sf):
    return FE.forest_importances(T.wide(spark, sf), num_trees=60)


QUERIES = {
    "features_label_map": q_label_map,
    "features_encoded": q_encoded,
    "features_signed_log": q_signed_log,
    "features_train_stats": q_stats,
    "features_scaled_signedlog": q_scaled_signedlog,
    "features_scaled_standard": q_scaled_standard,
    "features_constant": q_constant,
    "features_class_histogram": q_histogram,
    "features_corr_matrix": q_corr,
    "features_corr_drop": q_corr_drop,
    "features_corr_drop_planted": q_corr_drop_planted,
    "features_label_corr_constant": q_label_corr_constant,
    "features_label_corr_top": q_label_corr,
    "features_label_corr_matrix": q_top_matrix,
    "features_forest_importance": q_forest,
}

_SPLIT = ("sfl", f"""SELECT *, CASE WHEN {unit_of(key('row_id', 'split'))} < 0.75e0 THEN 'train'
 WHEN {unit_of(key('row_id', 'split'))} < 0.875e0 THEN 'val' ELSE 'test' END AS split FROM flows""")


def _slog(x):
    return f"(sign({x}) * ln(1 + abs({x})))"


def _scaled_sql(mode: str) -> str:
    tr = (lambda c: _slog(c)) if mode == "signedlog" else (lambda c: c)
    t = ("tt", "SELECT row_id, split, " + ", ".join(f"{tr(c)} AS {c}" for c in FEATS) + " FROM sfl")
    st = ("st", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)
          + " FROM tt WHERE split = 'train'")
    cols = []
    for c in FEATS:
        z = f"(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0e0 ELSE s_{c} END)"
        if mode == "signedlog":
            z = f"greatest(-10.0e0, least(10.0e0, {z}))"
        cols.append(f"round({z}, 6) AS {c}")
    return with_fixtures("flows", "SELECT row_id, split, " + ", ".join(cols) + " FROM tt, st", [_SPLIT, t, st])


_WIDTH = repr(10.0 / 60)

_PLANTED = ("planted", """
SELECT row_id, label_id, CAST(pos AS INTEGER) AS pos, value FROM wide_long
UNION ALL SELECT row_id, label_id, 64, 2 * value + 1 FROM wide_long WHERE pos = 0
UNION ALL SELECT a.row_id, a.label_id, 65, a.value + 0.02e0 * b.value
FROM wide_long a JOIN wide_long b ON a.row_id = b.row_id WHERE a.pos = 1 AND b.pos = 2
UNION ALL SELECT row_id, label_id, 66, 5.0e0 FROM wide_long WHERE pos = 0""")

ORACLE = {
    "features_label_map": with_fixtures("flows", "SELECT * FROM lm", [LABEL_MAP]),
    "features_encoded": with_fixtures("flows", """
SELECT row_id, label_id, CAST(upper(trim(label)) <> 'BENIGN' AS INTEGER) AS is_attack FROM fl""", [LABEL_MAP, FLOWS_ENC]),
    "features_signed_log": with_fixtures("flows", "SELECT row_id, " + ", ".join(
        f"round({_slog(c)}, 6) AS {c}" for c in FEATS) + " FROM flows"),
    "features_train_stats": with_fixtures("flows", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM sfl WHERE split = 'train'"
        for c in FEATS + ["f_const"]), [_SPLIT]),
    "features_scaled_signedlog": _scaled_sql("signedlog"),
    "features_scaled_standard": _scaled_sql("standard"),
    "features_constant": with_fixtures("flows", " UNION ALL ".join(
        f"SELECT '{c}' AS feature FROM flows HAVING max({c}) = min({c})" for c in FEATS + ["f_const"])),
    "features_class_histogram": with_fixtures("wide_long", f"""
SELECT label_id, pos, bin, round(cnt / (sum(cnt) OVER (PARTITION BY label_id, pos) * {_WIDTH}), 6) AS density
FROM (SELECT label_id, pos,
             CAST(least(59, floor((greatest(-5.0e0, least(5.0e0, value)) + 5.0e0) / {_WIDTH})) AS INTEGER) AS bin,
             count(*) AS cnt
      FROM wide_long GROUP BY 1, 2, 3) h"""),
    "features_corr_matrix": with_fixtures("wide_long", """
SELECT a.pos AS i, b.pos AS j, round(corr(a.value, b.value), 6) AS r
FROM wide_long a JOIN wide_long b ON a.row_id = b.row_id GROUP BY a.pos, b.pos"""),
    "features_corr_drop": with_fixtures("wide_long", """
SELECT DISTINCT j AS feature FROM (
  SELECT a.pos AS i, b.pos AS j, corr(a.value, b.value) AS r
  FROM wide_long a JOIN wide_long b ON a.row_id = b.row_id AND a.pos < b.pos GROUP BY a.pos, b.pos) c
WHERE abs(r) > 0.95e0"""),
    "features_corr_drop_planted": with_fixtures("wide_long", """
SELECT DISTINCT j AS feature FROM (
  SELECT a.pos AS i, b.pos AS j, corr(a.value, b.value) AS r
  FROM planted a JOIN planted b ON a.row_id = b.row_id AND a.pos < b.pos WHERE b.pos < 66 GROUP BY a.pos, b.pos) c
WHERE abs(r) > 0.95e0""", [_PLANTED]),
    "features_label_corr_constant": with_fixtures("wide_long", """
SELECT pos, CASE WHEN max(value) > min(value) THEN round(abs(corr(value, CAST(label_id <> 0 AS DOUBLE))), 6) END AS abs_corr
FROM planted GROUP BY pos""", [_PLANTED]),
    "features_label_corr_top": with_fixtures("wide_long", f"""
SELECT CAST(rank AS INTEGER) AS rank, pos, round(abs_corr, 6) AS abs_corr FROM (
  SELECT pos, abs_corr, row_number() OVER (ORDER BY abs_corr DESC, pos) AS rank FROM (
    SELECT pos, abs(corr(value, CAST(label_id <> 0 AS DOUBLE))) AS abs_corr FROM wide_long GROUP BY pos) c) r
WHERE rank <= {TOP_K}"""),
    "features_label_corr_matrix": with_fixtures("wide_long", """
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(corr(a.value, b.value), 6) AS r
FROM wide_long a JOIN top t ON a.pos = t.pos JOIN wide_long b ON a.row_id = b.row_id JOIN top u ON b.pos = u.pos GROUP BY a.pos, b.pos""", [
        ("top", "SELECT pos FROM (SELECT pos, abs(corr(value, CAST(label_id <> 0 AS DOUBLE))) AS c FROM wide_long GROUP BY pos) x ORDER BY c DESC, pos LIMIT 25")]),
}
