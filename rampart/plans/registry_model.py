"""Registered queries: scoring, gradient steps, training runs and library baselines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rampart.operators import metrics as M
from rampart.operators import sampling as S
from rampart.operators.model import LinearModel, gradient_sql, gradients, score, sgd_step, true_class_proba
from rampart.plans import centralized as CZ
from rampart.plans import federated as FD
from rampart.plans import registry_sampling as RS
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import key
from rampart.sources import tables as T

N_WIDE_CLASSES = 10
STEP_LR = 0.01
STEP_ALPHA = 1e-4
N_SILOS = 5


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def class_mean_model(spark, sf) -> LinearModel:
    """Coefficient row c = mean embedding of client/class c (F-updates), zero intercepts."""
    rows = T.client_updates(spark, sf).collect()      # classes x 64 values
    coef = np.zeros((N_WIDE_CLASSES, T.N_WIDE))
    for r in rows:
        coef[int(r["client_id"]), int(r["pos"])] = float(r["value"])
    return LinearModel(coef, np.zeros(N_WIDE_CLASSES), N_WIDE_CLASSES)


def q_score(spark, sf):
    sc = score(T.wide(spark, sf), class_mean_model(spark, sf))
    return sc.select("row_id", "prediction", r6("p_max").alias("p_max"))


def q_log_loss(spark, sf):
    sc = score(T.wide(spark, sf), class_mean_model(spark, sf)).withColumn("p_true", true_class_proba())
    return M.log_loss(sc).select(r6("loss").alias("loss"))


def q_silo_validation(spark, sf):
    sc = score(T.wide(spark, sf), class_mean_model(spark, sf)).withColumn("p_true", true_class_proba())
    v = sc.select((F.col("row_id") % 5).cast("int").alias("silo_id"), "p_true", F.col("label_id").alias("y_true"), F.col("prediction").alias("y_pred"))
    return M.silo_validation(v).select("silo_id", "num_examples", *[r6(c).alias(c) for c in ("val_loss", "val_accuracy", "val_f1", "val_fpr")])


def _step_inputs(spark, sf):
    w = T.wide(spark, sf)
    part = S.iid_partition(w, "row_id", N_SILOS, 42).withColumn("train_label", F.col("label_id"))
    cw = FD.class_weights_of(w, N_WIDE_CLASSES)
    return part, cw


def q_gradient_step(spark, sf):
    part, cw = _step_inputs(spark, sf)
    zero = LinearModel.zeros(T.N_WIDE, N_WIDE_CLASSES)
    g = gradients(part, {s: zero for s in range(N_SILOS)}, T.N_WIDE, class_weights=cw)
    rows = []
    for s, (n, _, grad) in g.items():
        for p, v in enumerate(sgd_step(zero, n, grad, STEP_LR, STEP_ALPHA).flat()):
            rows.append((s, p, float(v)))
    return spark.createDataFrame(rows, "silo_id int, pos int, value double").select(
        "silo_id", "pos", r6("value").alias("value"))


def q_gradient_sql(spark, sf):
    part, cw = _step_inputs(spark, sf)
    zero = LinearModel.zeros(T.N_WIDE, N_WIDE_CLASSES)
    g = gradient_sql(part, zero, cw)
    return g.select(F.col("silo_id").cast("int").alias("silo_id"), F.col("pos").cast("int").alias("pos"),
                    r6(F.lit(-STEP_LR) * F.col("grad") / F.col("n")).alias("value"))


def q_federated(spark, sf):
    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    cfg = FD.RunConfig(rounds=20, aggregation="fedavg", run_name="fedavg_iid")
    return FD.run_federated(spark, tr, te, va, nf, nc, cfg)


def q_federated_attack(spark, sf):
    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    cfg = FD.RunConfig(rounds=20, aggregation="multikrum", attack="label_flip", malicious_fraction=0.2,
                       partition_alpha=0.5, run_name="multikrum_flip")
    return FD.run_federated(spark, tr, te, va, nf, nc, cfg)


def q_sweep(spark, sf):
    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    return CZ.alpha_sweep(tr, va, te, nf, nc, alphas=(1e-6, 1e-5, 1e-4), epochs=5)


def q_forest(spark, sf):
    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    return CZ.forest_baseline(tr, va, te, nf, nc, num_trees=100)


def q_gbt(spark, sf):
    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    return CZ.gbt_baseline(tr, va, te, nf, nc, max_iter=100)


def q_aligned_average(spark, sf):
    """One-shot average of per-silo class means with class alignment (missing class -> 0)."""
    d = S.dirichlet_partition(T.wide(spark, sf), "row_id", S.dirichlet_proportions(N_WIDE_CLASSES, N_SILOS, 0.1, 42),
                              seed=42)
    local = d.select("silo_id", "label_id", F.posexplode("features").alias("pos", "value")).groupBy(
        "silo_id", "label_id", "pos").agg(F.avg("value").alias("value"))
    sizes = d.groupBy("silo_id").agg(F.count(F.lit(1)).alias("num_examples"))
    avg = CZ.class_aligned_average(local, sizes, N_WIDE_CLASSES, T.N_WIDE, spark)
    return avg.select("label_id", "pos", r6("value").alias("value"))


QUERIES = {
    "model_score": q_score,
    "metrics_log_loss": q_log_loss,
    "metrics_silo_validation": q_silo_validation,
    "model_gradient_step": q_gradient_step,
    "model_gradient_step_sql": q_gradient_sql,
    "model_class_aligned_average": q_aligned_average,
    "model_federated_run": q_federated,
    "model_federated_attack_run": q_federated_attack,
    "model_centralized_sweep": q_sweep,
    "model_random_forest": q_forest,
    "model_gbt": q_gbt,
}

SCORE_CTES = _SCORE = [
    ("z", "SELECT w.row_id, w.label_id, u.client_id AS cls, sum(w.value * u.value) AS z "
          "FROM wide_long w JOIN updates u ON w.pos = u.pos GROUP BY w.row_id, w.label_id, u.client_id"),
    ("p", "SELECT row_id, label_id, cls, z, 1.0e0 / (1.0e0 + exp(-z)) AS s FROM z"),
    ("pn", "SELECT *, s / sum(s) OVER (PARTITION BY row_id) AS proba, "
           "row_number() OVER (PARTITION BY row_id ORDER BY z DESC, cls) AS rk FROM p"),
]

_STEP = with_fixtures("wide_long", f"""
SELECT silo_id, CAST(pos AS INTEGER) AS pos, round(-{STEP_LR}e0 * g / n, 6) AS value FROM (
  SELECT a.silo_id, CASE WHEN a.pos = 64 THEN 640 + c.cls ELSE c.cls * 64 + a.pos END AS pos,
         sum(CASE WHEN a.label_id = c.cls THEN cw.weight ELSE 1.0e0 END
             * (0.5e0 - CAST(a.label_id = c.cls AS DOUBLE)) * a.value) AS g,
         any_value(sz.n) AS n
  FROM xa a CROSS JOIN (SELECT range AS cls FROM range(10)) c
  JOIN cw ON cw.label_id = c.cls
  JOIN sz ON sz.silo_id = a.silo_id
  GROUP BY 1, 2) t""", [
    ("rk", f"SELECT row_id, {key('row_id', 42)} AS k, label_id FROM (SELECT DISTINCT row_id, label_id FROM wide_long) d"),
    ("iid", f"""SELECT row_id, CAST(CASE WHEN rk - 1 < (n % 5) * (n // 5 + 1) THEN (rk - 1) // (n // 5 + 1)
         ELSE (n % 5) + (rk - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS silo_id
       FROM (SELECT row_id, row_number() OVER (ORDER BY k, row_id) AS rk, count(*) OVER () AS n FROM rk) r"""),
    ("xa", "SELECT i.silo_id, w.row_id, w.label_id, w.pos, w.value FROM wide_long w JOIN iid i USING (row_id) "
           "UNION ALL SELECT i.silo_id, r.row_id, r.label_id, 64, 1.0e0 FROM rk r JOIN iid i USING (row_id)"),
    ("cw", "SELECT label_id, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM rk GROUP BY label_id"),
    ("sz", "SELECT silo_id, count(*) AS n FROM iid GROUP BY silo_id"),
])

ORACLE = {
    "model_score": with_fixtures("updates", """
SELECT row_id, CAST(cls AS INTEGER) AS prediction, round(pm, 6) AS p_max FROM (
  SELECT row_id, arg_max(cls, rk = 1) AS cls, max(proba) AS pm FROM pn GROUP BY row_id) t""", _SCORE),
    "metrics_log_loss": with_fixtures("updates", """
SELECT round(avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, proba)))), 6) AS loss
FROM pn WHERE cls = label_id""", _SCORE),
    "metrics_silo_validation": with_fixtures("updates", """
SELECT silo_id, n AS num_examples, round(loss, 6) AS val_loss, round(acc, 6) AS val_accuracy, round(f1, 6) AS val_f1, round(fpr, 6) AS val_fpr FROM sv
UNION ALL
SELECT NULL, CAST(sum(n) AS BIGINT), round(sum(loss * n) / sum(n), 6), round(sum(acc * n) / sum(n), 6), round(sum(f1 * n) / sum(n), 6), round(sum(fpr * n) / sum(n), 6) FROM sv""",
                                            [*_SCORE, ("pv", """
SELECT row_id, CAST(row_id % 5 AS INTEGER) AS silo_id, label_id AS y, max(cls) FILTER (WHERE rk = 1) AS p, max(proba) FILTER (WHERE cls = label_id) AS pt
FROM pn GROUP BY row_id, label_id"""), ("sv", """
SELECT silo_id, count(*) AS n, avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, pt)))) AS loss, avg(CAST(y = p AS DOUBLE)) AS acc,
  coalesce(2.0e0 * count(*) FILTER (WHERE y <> 0 AND p <> 0) / nullif(count(*) FILTER (WHERE y <> 0) + count(*) FILTER (WHERE p <> 0), 0), 0) AS f1,
  coalesce(CAST(count(*) FILTER (WHERE y = 0 AND p <> 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 0), 0), 0) AS fpr
FROM pv GROUP BY silo_id""")]),
    "model_gradient_step": _STEP,
    "model_gradient_step_sql": _STEP,
    "model_class_aligned_average": with_fixtures("wide_long", """
SELECT CAST(g.label_id AS INTEGER) AS label_id, CAST(g.pos AS INTEGER) AS pos,
       round(sum(g.num_examples * coalesce(l.value, 0.0e0)) / sum(g.num_examples), 6) AS value
FROM (SELECT s.silo_id, s.num_examples, c.range AS label_id, p.range AS pos
      FROM (SELECT silo_id, count(*) AS num_examples FROM dir GROUP BY silo_id) s, range(10) c, range(64) p) g
LEFT JOIN (SELECT d.silo_id, d.label_id, w.pos, avg(w.value) AS value FROM dir d JOIN wide_long w USING (row_id)
           GROUP BY 1, 2, 3) l
  ON g.silo_id = l.silo_id AND g.label_id = l.label_id AND g.pos = l.pos
GROUP BY g.label_id, g.pos""", [
        ("fl", "SELECT DISTINCT row_id, label_id FROM wide_long"),
        RS._cuts_sql(S.dirichlet_proportions(N_WIDE_CLASSES, N_SILOS, 0.1, 42)),
        RS._DIR]),
}
