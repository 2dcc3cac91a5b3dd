"""Centralised baselines: logistic alpha sweep over one scan, random forest and boosted trees,
and the one-shot class-aligned average of local models."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions.attach import with_scalars
from rampart.operators import features as FE
from rampart.operators import metrics as M
from rampart.operators import sampling as S
from rampart.operators import trees as TR
from rampart.operators.model import LinearModel, confusion_of_models, train_local, train_to_convergence
from rampart.plans.federated import class_weights_of
from rampart.session import materialize
from rampart.sources import tables as T

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "precision", "recall", "f1", "fpr")


def flow_training_sets(spark: SparkSession, sf: str, mode: str = "signedlog"):
    """F-flows -> encoded labels, hash split, train-only scaling -> (train, val, test, n_features, n_classes)."""
    fl = T.flows(spark, sf)
    lmap = FE.label_map(fl)
    n_classes = lmap.count()
    enc = S.hash_split(FE.encode_labels(fl, lmap), "row_id", "split")
    scaled, kept, _ = FE.prepare_features(enc, T.FLOW_FEATURES, mode=mode)
    rows = materialize(scaled.select("row_id", "split", "label_id", F.array(*kept).alias("features")),
                       "flow-features", ["split"])
    sets = [rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    return sets[0], sets[1], sets[2], len(kept), n_classes


def _both_sets(val: DataFrame, test: DataFrame, *cols) -> DataFrame:
    """Validation and test rows in one frame, tagged by ``_set`` (scored in one pass)."""
    return val.select(*cols, F.lit("validation").alias("_set")).unionByName(test.select(*cols, F.lit("test").alias("_set")))


def _set_metrics(pred: DataFrame, y_true: Column, y_pred: Column) -> dict[str, dict]:
    """Metrics per ``_set`` from one confusion table (at most sets x C^2 cells collected)."""
    cells = pred.groupBy("_set", y_true.alias("_y"), y_pred.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    by: dict[str, list] = {}
    for r in cells:
        by.setdefault(r["_set"], []).append((int(r["_y"]), int(r["_p"]), int(r["_n"])))
    return {s: M.metrics_from_confusion_rows(by.get(s, [])) for s in ("validation", "test")}


def alpha_sweep(train: DataFrame, val: DataFrame, test: DataFrame, n_features: int, n_classes: int,
                alphas: Sequence[float] = (1e-6, 1e-5, 1e-4), epochs: int = 5, eta0: float = 0.01) -> DataFrame:
    """All regularisation values train on one shared scan per step; each is scored on val and test."""
    spark = train.sparkSession
    cw = class_weights_of(train, n_classes)
    tr = train.withColumn("train_label", F.col("label_id"))
    models = {i: LinearModel.zeros(n_features, n_classes) for i in range(len(alphas))}
    t0 = time.perf_counter()
    # one shared scan per step; per-alpha penalties applied on the driver
    for t in range(1, epochs + 1):
        from rampart.operators.model import gradients, learning_rate, sgd_step

        g = gradients(tr, models, n_features, class_weights=cw, shared=True)
        lr = learning_rate(eta0, t)
        models = {i: sgd_step(m, g[i][0], g[i][2], lr, alphas[i]) for i, m in models.items()}
    train_time = time.perf_counter() - t0
    # every alpha on validation and test in one scan; the predict time is that pass's wall time
    tp = time.perf_counter()
    sets = val.select("label_id", "features", F.lit("validation").alias("_set")).unionByName(
        test.select("label_id", "features", F.lit("test").alias("_set")))
    cells = confusion_of_models(sets, models)
    predict_time = time.perf_counter() - tp
    rows = []
    for i, a in enumerate(alphas):
        for split in ("validation", "test"):
            m = M.metrics_from_confusion_rows(cells.get((i, split), []))
            rows.append((f"Centralized logistic_sgd (alpha={a:g})", float(a), split, train_time,
                         predict_time, *[float(m[k]) for k in METRICS]))
    schema = ("model string, alpha double, split string, train_time_s double, predict_time_s double, "
              + ", ".join(f"{k} double" for k in METRICS))
    return spark.createDataFrame(rows, schema)


def _tree_rows(name: str, spark: SparkSession, fit_s: float, scored: DataFrame) -> DataFrame:
    """The result rows of one tree model: metrics on validation and test, and the times taken."""
    tp = time.perf_counter()
    met = _set_metrics(scored, F.col("label_id"), F.col("prediction"))
    predict_s = time.perf_counter() - tp
    rows = [(name, split, fit_s, predict_s, *[float(met[split][k]) for k in METRICS]) for split in ("validation", "test")]
    return spark.createDataFrame(rows, "model string, split string, train_time_s double, predict_time_s double, "
                                 + ", ".join(f"{k} double" for k in METRICS))


def forest_baseline(train: DataFrame, val: DataFrame, test: DataFrame, n_features: int, n_classes: int, num_trees: int = 100,
                    seed: int = 42) -> DataFrame:
    """Random forest without a depth limit, class weights balanced in every bootstrap
    (``operators/trees.py``); metrics on validation and test."""
    t0 = time.perf_counter()
    edges = TR.bin_edges(train, n_features)
    forest = TR.fit_forest(TR.binned(train, edges), n_features, n_classes, TR.ForestParams(trees=num_trees, seed=seed))
    fit_s = time.perf_counter() - t0
    scored = TR.predict_forest(_both_sets(val, test, "features", "label_id"), forest, edges, n_classes)
    return _tree_rows("Centralized random_forest", train.sparkSession, fit_s, scored)


def gbt_baseline(train: DataFrame, val: DataFrame, test: DataFrame, n_features: int, n_classes: int, max_iter: int = 100) -> DataFrame:
    """Histogram gradient boosting on the softmax loss of all classes (``operators/trees.py``);
    metrics on validation and test."""
    t0 = time.perf_counter()
    edges = TR.bin_edges(train, n_features)
    model = TR.fit_boosted(TR.binned(train, edges), n_features, n_classes, TR.BoostParams(iterations=max_iter))
    fit_s = time.perf_counter() - t0
    scored = TR.predict_boosted(_both_sets(val, test, "features", "label_id"), model, edges)
    return _tree_rows("Centralized hist_gradient_boosting", train.sparkSession, fit_s, scored)


def class_aligned_average(local: DataFrame, sizes: DataFrame, n_classes: int, n_features: int,
                          spark: SparkSession) -> DataFrame:
    """Size-weighted average of per-silo class parameters on the global class order.

    ``local(silo_id, label_id, pos, value)`` holds only the classes a silo saw; a missing
    class contributes 0, so the numerator sums the local rows only and the denominator is
    every silo's weight. The global parameter grid (classes x positions, the model size)
    is a range, left-joined so cells no silo saw come out 0.
    """
    w = F.col("num_examples").cast("double")
    num = local.join(sizes.select("silo_id", "num_examples"), "silo_id").groupBy("label_id", "pos").agg(
        F.sum(w * F.col("value")).alias("_num"))
    grid = spark.range(n_classes * n_features).select(
        (F.col("id") / n_features).cast("int").alias("label_id"), (F.col("id") % n_features).cast("int").alias("pos"))
    tot = sizes.agg(F.sum(w).alias("_den"))
    j = with_scalars(grid.join(num, ["label_id", "pos"], "left"), tot)
    return j.select("label_id", "pos", (F.coalesce("_num", F.lit(0.0)) / F.col("_den")).alias("value"))


def local_fit_average(train: DataFrame, n_features: int, n_classes: int, steps: int | None = None, eta0: float = 0.01,
                      alpha: float = 1e-4, balanced: bool = False, tol: float = 1e-4) -> LinearModel:
    """One-shot: every silo trains from zero to convergence (no component of its mean gradient
    beyond ``tol``), or for ``steps`` steps if given, then a size-weighted average.

    Class alignment: a silo's coefficient and intercept rows for classes it never saw count
    as 0 in the average (its local model has no such class). Local models are unweighted
    unless ``balanced``. The (silo, class) presence table has at most silos x classes rows.
    """
    present: dict[int, set[int]] = {}
    for r in train.select("silo_id", "label_id").distinct().collect():
        present.setdefault(int(r["silo_id"]), set()).add(int(r["label_id"]))
    silos = sorted(present)
    cw = class_weights_of(train, n_classes) if balanced else None
    tr = train.withColumn("train_label", F.col("label_id"))
    zero = {s: LinearModel.zeros(n_features, n_classes) for s in silos}
    if steps is None:
        seen_in = {s: np.array([c in present[s] for c in range(n_classes)]) for s in silos}
        models, stats = train_to_convergence(tr, zero, n_features, alpha, tol, seen=seen_in, class_weights=cw)
    else:
        models, stats = train_local(tr, zero, n_features, steps, eta0, alpha, class_weights=cw)

    def aligned(m: LinearModel, s: int) -> LinearModel:
        if m.binary:
            return m
        seen = np.array([c in present[s] for c in range(n_classes)], dtype=np.float64)
        return LinearModel(m.coef * seen[:, None], m.intercept * seen, n_classes)

    tot = sum(stats[s][0] for s in silos if s in stats)
    flat = sum(aligned(models[s], s).flat() * stats[s][0] for s in silos if s in stats) / tot
    return LinearModel.from_flat(np.asarray(flat), n_features, n_classes)
