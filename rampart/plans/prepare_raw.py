"""Raw flow CSVs -> cleaned, split, train-only selected and scaled feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions.attach import small_table
from rampart.functions.scalar import is_attack_label, signed_log1p
from rampart.operators import clean as C
from rampart.operators import features as FE
from rampart.operators import sampling as S
from rampart.plans.prepare import PrepareResult
from rampart.session import materialize
from rampart.sources import io as IO


def clean_rows(raw: DataFrame, feats: list[str]) -> tuple[DataFrame, dict]:
    """Complete, distinct rows with an id, and the cleaning funnel.

    Text cells that are no number, NaN and infinities make a row incomplete. Rows equal in all
    features and the label are one; it keeps the smallest given id, or gets a hash of its content.
    """
    typed = C.coerce_numeric(C.clean_labels(raw, IO.LABEL), feats)
    funnel = C.cleaning_funnel(typed, feats, [*feats, IO.LABEL]).head().asDict()
    whole = C.drop_incomplete(C.strict_clean(typed, feats), feats)
    given = F.min(F.col(IO.ROW_ID).cast("bigint")) if IO.ROW_ID in raw.columns else F.first(F.lit(None).cast("bigint"))
    one = whole.groupBy(*feats, IO.LABEL).agg(given.alias("_id"))
    row_id = F.coalesce("_id", F.xxhash64(*feats, IO.LABEL))
    return materialize(one.select(row_id.alias("row_id"), IO.LABEL, *feats), "raw-clean"), funnel


def select_on_train(train: DataFrame, feats: list[str], threshold: float = FE.CORR_THRESHOLD) -> dict[str, list[str]]:
    """{constant, correlated, kept}, judged on training rows only: constant columns go, then those
    whose signed-log values correlate beyond the threshold with an earlier column."""
    stats = FE.feature_stats(train, feats)
    constant = {r["feature"] for r in FE.constant_features(stats, by="range").collect()}
    left = [c for c in feats if c not in constant]
    corr = FE.correlation_matrix(train.select(F.array(*[signed_log1p(c) for c in left]).alias("features")))
    correlated = {left[r["feature"]] for r in FE.correlated_drop(corr, threshold).collect()}
    return {"constant": [c for c in feats if c in constant], "correlated": [c for c in left if c in correlated],
            "kept": [c for c in left if c not in correlated]}


def prepare_from_raw(spark: SparkSession, directory: str, out: str | None = None, label_mode: str = "multiclass",
                     sample_frac: float = 1.0, test_size: float = 0.2, corr_threshold: float = FE.CORR_THRESHOLD,
                     top_k: int | None = None, undersample_ratio: float = 0.0, seed: int = 42) -> PrepareResult:
    """Load every CSV of ``directory``, clean, sample, split by class, select and scale on the
    training rows, optionally keep the ``top_k`` most important features and undersample benign
    training rows, and write the feature store, its metadata and the funnel."""
    raw = IO.read_flow_csvs(spark, directory).drop("source_file")
    feats = [c for c in raw.columns if c not in (IO.LABEL, IO.ROW_ID)]
    rows, funnel = clean_rows(raw, feats)
    if sample_frac < 1.0:
        rows = S.stratified_sample_min(rows, "row_id", IO.LABEL, sample_frac, 20, seed)
    lmap = FE.label_map(rows, IO.LABEL)
    lmap = small_table(lmap) or lmap
    FE.require_benign(lmap)
    rows = FE.encode_labels(rows.withColumn("is_attack", is_attack_label(IO.LABEL)), lmap, IO.LABEL, label_mode)
    rows = materialize(S.stratified_split(rows, "row_id", IO.LABEL, test_size, seed), "raw-split")
    chosen = select_on_train(rows.where("split = 'train'"), feats, corr_threshold)
    scaled, kept, stats = FE.prepare_features(rows.drop(*chosen["constant"], *chosen["correlated"]), chosen["kept"])
    meta = {"dropped_constant": chosen["constant"], "dropped_correlated": chosen["correlated"], "funnel": funnel}
    if top_k and top_k < len(kept):
        vec = scaled.where("split = 'train'").select("label_id", F.array(*[F.col(c) for c in kept]).alias("features"))
        best = {r["pos"] for r in FE.top_importances(FE.forest_importances(vec, seed=seed), top_k).collect()}
        meta["dropped_low_importance"] = [c for i, c in enumerate(kept) if i not in best]
        kept = [c for i, c in enumerate(kept) if i in best]
    store = scaled.select("split", "row_id", "label_id", F.array(*[F.col(c) for c in kept]).alias("features"))
    if undersample_ratio > 0:
        train = S.undersample_benign(store.where("split = 'train'"), "row_id", ratio=undersample_ratio, seed=seed)
        store = train.unionByName(store.where("split <> 'train'"))
    of = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    classes = {r["label"]: r["label_id"] for r in lmap.collect()} if label_mode == "multiclass" else {"BENIGN": 0, "ATTACK": 1}
    meta |= {"feature_names": kept, "mean": [of[c][0] for c in kept], "std": [of[c][1] for c in kept], "class_map": classes, "label_mode": label_mode}
    if out:
        IO.write_feature_store(store, f"{out}/rows")
        meta["class_counts"] = {f"{r['split']}:{r['label_id']}": r["n"] for r in IO.class_counts_table(spark.read.parquet(f"{out}/rows")).collect()}
        IO.write_meta(spark, f"{out}/meta", meta)
        store = IO.read_feature_store(spark, f"{out}/rows")
    return PrepareResult(store, kept, len(set(classes.values())), meta)
