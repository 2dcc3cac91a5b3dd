"""Feature preparation: label encoding, train-only statistics, scaling, selection, profiles.

Statistics are one-pass aggregates over all rows (no sampling). The only things that
reach the driver are one-row statistic tables and the list of kept column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions.attach import lookup_join
from rampart.functions.scalar import BENIGN, clip, finite_or_zero, is_attack_label, signed_log1p

# Fixed values (defaults of the preparation step).
CONSTANT_STD = 1e-12
CLIP_SIGNEDLOG = 10.0
CORR_THRESHOLD = 0.95
HIST_BINS = 60
HIST_RANGE = 5.0
TRANSFORMS = ("signedlog", "standard")


# ------------------------------------------------------------------ labels
def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, label_id)``: every spelling of BENIGN (case-insensitive) is 0, other labels follow
    in sorted order (from 1; from 0 when there is no BENIGN).

    The window runs over the distinct labels only (one row per class).
    """
    d = df.select(F.trim(F.col(label).cast("string")).alias("label")).distinct()
    benign = F.coalesce(F.upper("label") == F.lit(BENIGN), F.lit(False))
    order = Window.orderBy(~benign, "label")
    n_benign = F.count_if(benign).over(Window.partitionBy(F.lit(1)))
    other = F.row_number().over(order) - n_benign - (n_benign == 0).cast("int")
    return d.select("label", F.when(benign, F.lit(0)).otherwise(other).cast("int").alias("label_id"))


def require_benign(lmap: DataFrame) -> None:
    """Raise when no BENIGN class exists (action on the tiny label map)."""
    if lmap.where(F.col("label_id") == 0).where(F.upper("label") == BENIGN).limit(1).count() == 0:
        raise ValueError("no BENIGN label found: class 0 must be benign")


def encode_labels(df: DataFrame, lmap: DataFrame, label: str = "label", mode: str = "multiclass") -> DataFrame:
    """Attach ``label_id`` (multiclass via the label map, or binary attack flag)."""
    if mode == "binary":
        return df.withColumn("label_id", is_attack_label(label))
    if mode != "multiclass":
        raise ValueError(f"unknown label mode {mode!r}")
    j = df.withColumn("_lbl", F.trim(F.col(label).cast("string")))
    # one label may hold most rows (BENIGN): the map is broadcast within a checked bound
    return lookup_join(j, lmap.withColumnRenamed("label", "_lbl"), on="_lbl", how="left").drop("_lbl")


# ------------------------------------------------------------------ statistics
def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean, population std, min, max (long form)."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in features)
    return wide.selectExpr(f"stack({len(features)}, {parts}) AS (feature, mean, std, min, max)")


def constant_features(stats: DataFrame, by: str = "std", tol: float = CONSTANT_STD) -> DataFrame:
    """Constant columns: ``max = min`` on raw data, or ``std <= tol`` after a transform."""
    cond = (F.col("max") == F.col("min")) if by == "range" else (F.col("std") <= F.lit(tol))
    return stats.where(cond).select("feature")


def transform(df: DataFrame, features: Sequence[str], mode: str = "signedlog") -> DataFrame:
    """Non-finite -> 0, then signed log (signedlog mode) on each feature."""
    if mode not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}")
    cols = {c: finite_or_zero(c) for c in features}
    if mode == "signedlog":
        cols = {c: signed_log1p(e) for c, e in cols.items()}
    return df.withColumns({c: e for c, e in cols.items()})


def standardize(df: DataFrame, stats: DataFrame | dict, features: Sequence[str], clip_at: float | None = None) -> DataFrame:
    """``(x - mean) / std`` with std 0 -> 1.

    ``stats`` (one row per feature, so bounded by the feature count) is collected and
    inlined as literals: no join, the expression stays in whole-stage codegen.
    """
    if not isinstance(stats, dict):
        stats = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    out = {}
    for c in features:
        mean, std = stats[c]
        std = 1.0 if not std else float(std)
        z = (F.col(c) - F.lit(float(mean))) / F.lit(std)
        out[c] = clip(z, -clip_at, clip_at) if clip_at else z
    return df.withColumns(out)


def prepare_features(df: DataFrame, features: Sequence[str], split_col: str = "split", train_value: str = "train",
                     mode: str = "signedlog") -> tuple[DataFrame, list[str], DataFrame]:
    """Transform, fit stats on train rows only, drop constant columns, scale (+clip in signedlog).

    Returns ``(scaled rows, kept feature names, stats of kept features)``. One aggregate
    job fits the statistics; its single row is the only thing collected.
    """
    t = transform(df, features, mode)
    stats = feature_stats(t.where(F.col(split_col) == train_value), features)
    srows = stats.collect()
    kept = [r["feature"] for r in srows if r["std"] is not None and r["std"] > CONSTANT_STD]
    dropped = [c for c in features if c not in kept]
    kept_stats = {r["feature"]: (r["mean"], r["std"]) for r in srows if r["feature"] in kept}
    out = standardize(t.drop(*dropped), kept_stats, kept, CLIP_SIGNEDLOG if mode == "signedlog" else None)
    # the statistics already collected (one row per feature) become a local table: no second pass
    local = df.sparkSession.createDataFrame([r for r in srows if r["feature"] in kept], stats.schema)
    return out, kept, local


# ------------------------------------------------------------------ profiles over long-form features
def class_histogram(long: DataFrame, label: str = "label_id", bins: int = HIST_BINS, lim: float = HIST_RANGE) -> DataFrame:
    """Class-conditional density per (label, pos): values clipped to [-lim, lim], ``bins`` equal bins."""
    width = 2 * lim / bins
    x = clip("value", -lim, lim)
    b = F.least(F.lit(bins - 1), F.floor((x + lim) / width).cast("int"))
    counts = long.groupBy(label, "pos", b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    tot = counts.groupBy(label, "pos").agg(F.sum("cnt").alias("_n"))
    return counts.join(tot, on=[label, "pos"]).select(
        label, "pos", "bin", (F.col("cnt") / (F.col("_n") * F.lit(width))).alias("density"))


def correlation_matrix(df: DataFrame, features_col: str = "features") -> DataFrame:
    """Pearson correlation of array features (MLlib: one distributed pass, F x F result).

    Returns long form ``(i, j, r)``.
    """
    spark = df.sparkSession
    vec = df.select(array_to_vector(features_col).alias("v"))
    m = Correlation.corr(vec, "v", "pearson").head()[0].toArray()
    k = m.shape[0]
    rows = [(i, j, float(m[i, j])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(rows, "i int, j int, r double")


def correlated_drop(corr: DataFrame, threshold: float = CORR_THRESHOLD) -> DataFrame:
    """Drop j if any earlier column i < j has |r| > threshold (non-greedy); a constant column has no r."""
    return corr.where((F.col("i") < F.col("j")) & (F.abs("r") > threshold) & ~F.isnan("r")).select(F.col("j").alias("feature")).distinct()


def label_correlation(long: DataFrame, y: str = "y_bin") -> DataFrame:
    """``|corr(x_pos, y)|`` per feature position from long-form ``(pos, value)`` rows; NULL for a
    constant feature or label."""
    return long.groupBy("pos").agg(_abs_corr(F.col("value"), F.col(y).cast("double")).alias("abs_corr"))


def _abs_corr(x: Column, y: Column) -> Column:
    return F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def label_correlation_wide(df: DataFrame, n_features: int, y: str = "y_bin", features: str = "features") -> DataFrame:
    """``|corr(x_j, y)|`` for every array element in one aggregate pass (no explode):
    ``n_features`` correlation aggregates side by side, then the one-row result is unpivoted."""
    yy = F.col(y).cast("double")
    row = df.agg(*[_abs_corr(F.element_at(features, j + 1), yy).alias(f"c{j}") for j in range(n_features)])
    parts = ", ".join(f"{j}, c{j}" for j in range(n_features))
    return row.selectExpr(f"stack({n_features}, {parts}) AS (pos, abs_corr)")


def top_correlation_matrix(df: DataFrame, n_features: int, k: int = 25, y: str = "y_bin", features: str = "features") -> DataFrame:
    """``(i, j, r)`` over the ``k`` features that correlate most with ``y``, i and j their positions
    (two passes: the ranking, then k columns alone). Constant features have no rank."""
    ranked = top_k(label_correlation_wide(df, n_features, y, features).where("abs_corr is not null"), k).orderBy("rank")
    at = [r["pos"] for r in ranked.collect()]  # at most k positions
    if not at:
        return df.sparkSession.createDataFrame([], "i int, j int, r double")
    m = correlation_matrix(df.select(F.array(*[F.element_at(features, p + 1) for p in at]).alias(features)), features)
    where = F.array(*[F.lit(p) for p in at])
    return m.select(F.element_at(where, F.col("i") + 1).alias("i"), F.element_at(where, F.col("j") + 1).alias("j"), "r")


def top_k(scores: DataFrame, k: int, score: str = "abs_corr", tie: str = "pos") -> DataFrame:
    """Top-k rows by score (ties: lower ``tie`` first) with their 1-based rank."""
    w = Window.orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_importances(imp: DataFrame, k: int, score: str = "importance", pos: str = "pos") -> DataFrame:
    """Top-k features by importance, returned in original column order (bounded: one row per feature)."""
    return top_k(imp, k, score, pos).orderBy(pos)


def most_important(imp: DataFrame, k: int = 20, score: str = "importance", pos: str = "pos") -> DataFrame:
    """The k most important features, least important of them first (the order of a bar chart)."""
    return top_k(imp, k, score, pos).orderBy(F.desc("rank"))


def forest_importances(df: DataFrame, features_col: str = "features", label: str = "label_id",
                       num_trees: int = 60, seed: int = 42, max_depth: int = 8) -> DataFrame:
    """Random-forest importance per feature position (MLlib)."""
    from pyspark.ml.classification import RandomForestClassifier

    data = df.select(array_to_vector(features_col).alias("fv"), F.col(label).cast("double").alias("y"))
    model = RandomForestClassifier(featuresCol="fv", labelCol="y", numTrees=num_trees, seed=seed,
                                   maxDepth=max_depth).fit(data)
    imp = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "pos int, importance double")
