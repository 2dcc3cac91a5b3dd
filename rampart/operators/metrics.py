"""Detection-quality metrics as aggregations.

All metrics read the scored rows once: a ``groupBy(y_true, y_pred).count()`` confusion
table (map-side combined, at most C*C rows) is the only thing that leaves the rows;
per-class and averaged scores are computed from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions.attach import with_scalars

# Fixed value: probability clip for log-loss (float64 machine epsilon).
EPS = 2.220446049250313e-16


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_binary(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     keys: Sequence[str] | None = None) -> DataFrame:
    """Attack-vs-benign confusion counts (class 0 = benign, any other class = attack)."""
    t = F.col(y_true) != 0
    p = F.col(y_pred) != 0
    return df.groupBy(*(keys or [])).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(F.col(y_true) == F.col(y_pred)).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
    )


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   keys: Sequence[str] | None = None) -> DataFrame:
    """accuracy (on original labels), precision, recall, f1, fpr; 0 on an empty denominator."""
    ks = list(keys or [])
    c = confusion_binary(df, y_true, y_pred, ks)
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    return c.select(
        *ks, "tp", "fp", "fn", "tn",
        _div(F.col("n_correct"), F.col("n")).alias("accuracy"),
        "precision", "recall",
        _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
              keys: Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), F.col(y_true).alias("y"), F.col(y_pred).alias("p")).agg(
        F.count(F.lit(1)).alias("cnt"))


def per_class_scores(conf: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Per class over the union of true and predicted classes: support, tp, precision, recall, f1."""
    ks = list(keys or [])
    true_side = conf.groupBy(*ks, F.col("y").alias("cls")).agg(
        F.sum("cnt").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("cnt")).otherwise(0)).alias("tp"))
    pred_side = conf.groupBy(*ks, F.col("p").alias("cls")).agg(F.sum("cnt").alias("predicted"))
    j = true_side.join(pred_side, on=ks + ["cls"], how="full_outer").select(
        *ks, "cls",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"),
    )
    prec = _div(F.col("tp"), F.col("predicted"))
    rec = _div(F.col("tp"), F.col("support"))
    return j.select(
        *ks, "cls", "support", "tp", "predicted",
        prec.alias("precision"), rec.alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def multiclass_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                       keys: Sequence[str] | None = None) -> DataFrame:
    """accuracy, balanced accuracy (classes present in y_true), macro-F1 (union of classes), weighted-F1."""
    ks = list(keys or [])
    pc = per_class_scores(confusion(df, y_true, y_pred, ks), ks)
    return pc.groupBy(*ks).agg(
        _div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def detection_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                      keys: Sequence[str] | None = None) -> DataFrame:
    """The full metric row logged per round (multiclass + attack view)."""
    ks = list(keys or [])
    m = multiclass_metrics(df, y_true, y_pred, ks)
    b = binary_metrics(df, y_true, y_pred, ks).drop("accuracy")
    return m.join(b, on=ks, how="inner") if ks else with_scalars(m, b)


def log_loss(df: DataFrame, p_true: str = "p_true", keys: Sequence[str] | None = None) -> DataFrame:
    """Mean negative log-likelihood of the true class, probabilities clipped to [eps, 1-eps]."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(p_true)))
    return df.groupBy(*(keys or [])).agg(F.avg(-F.log(p)).alias("loss"))


def silo_validation(df: DataFrame, silo: str = "silo_id", p_true: str = "p_true", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """What each silo reports of its validation rows, and their mean weighted by rows (silo NULL):
    ``(silo, num_examples, val_loss, val_accuracy, val_f1, val_fpr)``."""
    own = log_loss(df, p_true, [silo]).join(df.groupBy(silo).agg(F.count(F.lit(1)).alias("num_examples")), silo) \
        .join(detection_metrics(df, y_true, y_pred, [silo]), silo)
    named = {"val_loss": "loss", "val_accuracy": "accuracy", "val_f1": "f1", "val_fpr": "fpr"}
    out = own.select(silo, "num_examples", *[F.col(v).alias(k) for k, v in named.items()])
    w = F.col("num_examples")
    mean = out.agg(F.sum(w).alias("num_examples"), *[_div(F.sum(F.col(k) * w), F.sum(F.when(F.col(k).isNotNull(), w))).alias(k) for k in named])
    return out.unionByName(mean.select(F.lit(None).cast(out.schema[silo].dataType).alias(silo), *mean.columns))


def balanced_class_weights(df: DataFrame, label: str = "label_id", keys: Sequence[str] | None = None) -> DataFrame:
    """``n / (k * count_c)`` for classes present (k = number of present classes)."""
    ks = list(keys or [])
    counts = df.groupBy(*ks, F.col(label).alias("label_id")).agg(F.count(F.lit(1)).alias("cnt"))
    tot = counts.groupBy(*ks).agg(F.sum("cnt").alias("_n"), F.count(F.lit(1)).alias("_k"))
    j = counts.join(tot, on=ks, how="inner") if ks else with_scalars(counts, tot)
    return j.select(*ks, "label_id", "cnt", (F.col("_n") / (F.col("_k") * F.col("cnt"))).alias("weight"))


def metrics_from_confusion(conf: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The full metric row from a confusion table ``(keys, y, p, cnt)`` (at most C*C rows per key)."""
    ks = list(keys or [])
    pc = per_class_scores(conf, ks)
    m = pc.groupBy(*ks).agg(
        _div(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    t, p, n = F.col("y") != 0, F.col("p") != 0, F.col("cnt")
    b = conf.groupBy(*ks).agg(
        F.sum(F.when(t & p, n).otherwise(0)).alias("tp"), F.sum(F.when(~t & p, n).otherwise(0)).alias("fp"),
        F.sum(F.when(t & ~p, n).otherwise(0)).alias("fn"), F.sum(F.when(~t & ~p, n).otherwise(0)).alias("tn"))
    b = b.withColumn("precision", _div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", _div(F.col("tp"), F.col("tp") + F.col("fn")))
    b = b.select(*ks, "tp", "fp", "fn", "tn", "precision", "recall",
                 _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
                 _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))
    return m.join(b, on=ks, how="inner") if ks else with_scalars(m, b)


def metrics_from_confusion_rows(rows: list[tuple[int, int, int]]) -> dict[str, float]:
    """Same metrics as ``metrics_from_confusion`` for one collected confusion table.

    ``rows`` = (y_true, y_pred, count) cells, at most C*C of them; used by the round
    loop, where a Spark job per round on a table this small is pure scheduling cost.
    """
    support: dict[int, int] = {}
    predicted: dict[int, int] = {}
    tp: dict[int, int] = {}
    tpb = fpb = fnb = tnb = 0
    for y, p, n in rows:
        support[y] = support.get(y, 0) + n
        predicted[p] = predicted.get(p, 0) + n
        if y == p:
            tp[y] = tp.get(y, 0) + n
        if y != 0 and p != 0:
            tpb += n
        elif y == 0 and p != 0:
            fpb += n
        elif y != 0:
            fnb += n
        else:
            tnb += n
    classes = set(support) | set(predicted)
    tot = sum(support.values())

    def div(a, b):
        return a / b if b else 0.0

    f1 = {c: div(2 * tp.get(c, 0), support.get(c, 0) + predicted.get(c, 0)) for c in classes}
    rec = {c: div(tp.get(c, 0), support[c]) for c in support}
    prec_b, rec_b = div(tpb, tpb + fpb), div(tpb, tpb + fnb)
    return {
        "accuracy": div(sum(tp.values()), tot),
        "balanced_accuracy": sum(rec.values()) / len(rec) if rec else 0.0,
        "macro_f1": sum(f1.values()) / len(f1) if f1 else 0.0,
        "weighted_f1": div(sum(f1[c] * support.get(c, 0) for c in classes), tot),
        "precision": prec_b, "recall": rec_b, "f1": div(2 * prec_b * rec_b, prec_b + rec_b),
        "fpr": div(fpb, fpb + tnb),
    }
