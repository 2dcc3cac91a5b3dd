"""Registered queries: detection metrics (F-preds fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import features as FE
from rampart.operators import metrics as M
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import FLOWS_ENC, LABEL_MAP
from rampart.sources import tables as T


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def multiclass_preds(spark, sf):
    """F-preds multiclass: truth = encoded flow label, prediction = f_k mod 5."""
    fl = T.flows(spark, sf)
    enc = FE.encode_labels(fl, FE.label_map(fl))
    return enc.select("row_id", "org", F.col("label_id").alias("y_true"),
                      (F.col("f_k").cast("int") % 5).alias("y_pred"))


def q_binary(spark, sf):
    m = M.binary_metrics(T.binary_preds(spark, sf))
    return m.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")])


def q_multiclass(spark, sf):
    m = M.multiclass_metrics(multiclass_preds(spark, sf))
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def q_per_class(spark, sf):
    pc = M.per_class_scores(M.confusion(multiclass_preds(spark, sf)))
    return pc.select(F.col("cls").cast("int").alias("cls"), "support", "tp", "predicted",
                     *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def q_by_silo(spark, sf):
    m = M.detection_metrics(multiclass_preds(spark, sf), keys=["org"])
    cols = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "precision", "recall", "f1", "fpr"]
    return m.select("org", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in cols])


def q_weights(spark, sf):
    fl = T.flows(spark, sf)
    enc = FE.encode_labels(fl, FE.label_map(fl))
    return M.balanced_class_weights(enc).select("label_id", "cnt", r6("weight").alias("weight"))


QUERIES = {
    "metrics_binary": q_binary,
    "metrics_multiclass": q_multiclass,
    "metrics_per_class": q_per_class,
    "metrics_by_silo": q_by_silo,
    "metrics_class_weights": q_weights,
}

_PREDS = ("pr", "SELECT row_id, org, label_id AS y_true, CAST(f_k AS INTEGER) % 5 AS y_pred FROM fl")
_PC = ("pc", """
SELECT coalesce(t.cls, p.cls) AS cls, coalesce(t.support, 0) AS support, coalesce(t.tp, 0) AS tp,
       coalesce(p.predicted, 0) AS predicted{keysel}
FROM (SELECT {keys}y_true AS cls, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp
      FROM pr GROUP BY {keys}y_true) t
FULL OUTER JOIN (SELECT {keys}y_pred AS cls, count(*) AS predicted FROM pr GROUP BY {keys}y_pred) p
  ON t.cls = p.cls{keyjoin}""")


def _pc(keys: str = ""):
    if not keys:
        return (_PC[0], _PC[1].format(keys="", keysel="", keyjoin=""))
    return (_PC[0], _PC[1].format(keys=f"{keys}, ", keysel=f", coalesce(t.{keys}, p.{keys}) AS {keys}",
                                  keyjoin=f" AND t.{keys} = p.{keys}"))


_MC = """
  CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
  avg(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support END) AS balanced_accuracy,
  avg(2.0e0 * tp / (support + predicted)) AS macro_f1,
  sum(2.0e0 * tp / (support + predicted) * support) / sum(support) AS weighted_f1"""

_BIN = """
SELECT {keys}count(*) FILTER (WHERE y_true <> 0 AND y_pred <> 0) AS tp,
       count(*) FILTER (WHERE y_true = 0 AND y_pred <> 0) AS fp,
       count(*) FILTER (WHERE y_true <> 0 AND y_pred = 0) AS fn,
       count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
       CAST(count(*) FILTER (WHERE y_true = y_pred) AS DOUBLE) / count(*) AS accuracy
FROM {src} {group}"""

_BIN_DERIVED = """
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0e0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0e0) AS recall,
       coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0e0) AS fpr"""

ORACLE = {
    "metrics_binary": with_fixtures("bpreds", """
SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0e0), 6) AS f1, round(fpr, 6) AS fpr
FROM (SELECT *, """ + _BIN_DERIVED + " FROM (" + _BIN.format(keys="", src="bpreds", group="") + ") b) c"),
    "metrics_multiclass": with_fixtures("flows", "SELECT round(accuracy, 6) AS accuracy, "
                                        "round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, "
                                        "round(weighted_f1, 6) AS weighted_f1 FROM (SELECT " + _MC + " FROM pc) m",
                                        [LABEL_MAP, FLOWS_ENC, _PREDS, _pc()]),
    "metrics_per_class": with_fixtures("flows", """
SELECT CAST(cls AS INTEGER) AS cls, support, tp, predicted,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0e0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0e0), 6) AS recall,
       round(2.0e0 * tp / (support + predicted), 6) AS f1 FROM pc""", [LABEL_MAP, FLOWS_ENC, _PREDS, _pc()]),
    "metrics_by_silo": with_fixtures("flows", """
SELECT b.org, tp, fp, fn, tn, round(m.accuracy, 6) AS accuracy, round(m.balanced_accuracy, 6) AS balanced_accuracy,
       round(m.macro_f1, 6) AS macro_f1, round(m.weighted_f1, 6) AS weighted_f1,
       round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0e0), 6) AS f1, round(fpr, 6) AS fpr
FROM (SELECT *, """ + _BIN_DERIVED + " FROM (" + _BIN.format(keys="org, ", src="pr", group="GROUP BY org") + """) b0) b
JOIN (SELECT org, """ + _MC + """ FROM pc GROUP BY org) m ON b.org = m.org""",
                                     [LABEL_MAP, FLOWS_ENC, _PREDS, _pc("org")]),
    "metrics_class_weights": with_fixtures("flows", """
SELECT label_id, count(*) AS cnt,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM fl GROUP BY label_id""",
                                           [LABEL_MAP, FLOWS_ENC]),
}
