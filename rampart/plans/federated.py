"""Silo training run: partition -> local steps -> (attack) -> robust aggregation -> evaluate -> log.

The flow rows are prepared once (silo id, per-silo validation flag, oversampling weight,
possibly flipped training label), written as Parquet under the session's shared
checkpoint folder and read back, which cuts lineage and survives executor loss. Every
round runs a handful of jobs over those rows; only parameters (silos x classes x
features doubles) move between driver and executors. The rows are not cached: each pass
re-reads the compact Parquet copy (column-pruned), which holds at any size, where a cache
of the whole training set would not fit executor memory at scale.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.functions.attach import lookup_join
from rampart.operators import metrics as M
from rampart.operators import robust as R
from rampart.operators import sampling as S
from rampart.operators.model import LinearModel, evaluated_gradients, score, train_local, true_class_proba
from rampart.session import materialize, scratch_path
from rampart.sources import io as IO


# Rebalancing modes (oversampling as weights and/or balanced class weights).
REBALANCE = ("oversample+weights", "weights", "oversample", "none")


@dataclass
class RunConfig:
    # Defaults of a run.
    rounds: int = 20
    local_epochs: int = 2
    learning_rate: float = 0.01
    model_alpha: float = 1e-4
    partition_alpha: float = 0.0
    seed: int = 42
    attack: str = "none"
    malicious_fraction: float = 0.0
    poison_scale: float = 3.0
    aggregation: str = "fedavg"
    defense_fraction: float = -1.0
    trim_ratio: float = -1.0
    n_silos: int = 5
    val_fraction: float = 0.2
    rebalance: str = "oversample+weights"   # or "weights", "oversample", "none"
    weight: str = "examples"                # fedavg weight: post-oversampling examples, or "raw"
    run_name: str | None = None
    extra: dict = field(default_factory=dict)

    def label(self) -> str:
        """Name of the run in its log: ``run_name``, or the settings that tell runs apart."""
        if self.run_name:
            return self.run_name
        told = {"rule": self.aggregation, "attack": self.attack, "silos": self.n_silos, "seed": self.seed}
        if self.attack != "none":
            told["fraction"] = f"{self.malicious_fraction:g}"
        if self.partition_alpha > 0:
            told["alpha"] = f"{self.partition_alpha:g}"
        return " ".join(f"{k}={v}" for k, v in told.items())


ROUND_SCHEMA = T.StructType([
    T.StructField("run_name", T.StringType()), T.StructField("aggregation", T.StringType()),
    T.StructField("attack", T.StringType()), T.StructField("malicious_fraction", T.DoubleType()),
    T.StructField("partition_alpha", T.DoubleType()), T.StructField("model_alpha", T.DoubleType()),
    T.StructField("local_epochs", T.IntegerType()), T.StructField("seed", T.IntegerType()),
    T.StructField("round", T.IntegerType()), T.StructField("loss", T.DoubleType()),
    *[T.StructField(m, T.DoubleType()) for m in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1",
                                                 "precision", "recall", "f1", "fpr")],
    *[T.StructField(f"val_{m}", T.DoubleType()) for m in ("loss", "accuracy", "balanced_accuracy", "macro_f1",
                                                         "weighted_f1", "precision", "recall", "f1", "fpr")],
    T.StructField("elapsed_s", T.DoubleType()),
    T.StructField("clients", T.IntegerType()), T.StructField("malicious_in_round", T.IntegerType()),
    T.StructField("kept_clients", T.IntegerType()), T.StructField("malicious_kept", T.IntegerType()),
    T.StructField("agg_time_s", T.DoubleType()), T.StructField("train_loss", T.DoubleType()),
    T.StructField("bytes_up", T.LongType()), T.StructField("bytes_down", T.LongType()),
])


def class_weights_of(train: DataFrame, n_classes: int) -> np.ndarray:
    """Balanced weights over the whole training set; absent classes weigh 1."""
    rows = M.balanced_class_weights(train).collect()   # one row per class
    w = np.ones(n_classes)
    for r in rows:
        w[int(r["label_id"])] = float(r["weight"])
    return w


def prepare_silo_rows(train: DataFrame, cfg: RunConfig, n_classes: int, spark: SparkSession) -> DataFrame:
    """Partition, per-silo validation flag, oversampling weight and attacked label, written once.

    The silo partition and the per-silo validation split are rank cutoffs (see
    ``sampling.rank_tag``): the rows are scanned and tagged in place, never shuffled; the
    oversampling weights are a (silo, class) table broadcast behind its size check.
    """
    if cfg.partition_alpha <= 0:
        part = S.iid_partition(train, "row_id", cfg.n_silos, cfg.seed)
    else:
        counts = {int(r["label_id"]): int(r["count"]) for r in train.groupBy("label_id").count().collect()}
        props = S.dirichlet_proportions(n_classes, cfg.n_silos, cfg.partition_alpha, cfg.seed, counts)
        part = S.dirichlet_partition(train, "row_id", props, seed=cfg.seed)
    part = S.silo_validation_split(part, "row_id", val_fraction=cfg.val_fraction, seed=f"{cfg.seed}:val")
    tr = part.where(F.col("part") == "train")
    if "oversample" in cfg.rebalance:
        w = S.oversample_weights(tr).select("silo_id", "label_id", F.col("weight").alias("w_row"))
        rows = lookup_join(part, w, ["silo_id", "label_id"], how="left").fillna({"w_row": 1.0})
    else:
        rows = part.withColumn("w_row", F.lit(1.0))
    n_mal = int(round(cfg.malicious_fraction * cfg.n_silos)) if cfg.attack != "none" else 0
    rows = rows.withColumn("malicious", (F.col("silo_id") < n_mal).cast("int"))
    if cfg.attack == "label_flip":
        rows = R.flip_labels(rows, n_classes)
    else:
        rows = rows.withColumn("train_label", F.col("label_id"))
    path = scratch_path(spark, f"silo-rows-{uuid.uuid4().hex}")
    rows.select("row_id", "silo_id", "part", "label_id", "train_label", "w_row", "malicious", "features") \
        .write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def evaluate(model: LinearModel, test: DataFrame, val: DataFrame | None) -> dict[str, float]:
    """Test and validation metrics plus log-loss from one scan of both sets.

    The scan produces a confusion table with summed log-loss per cell (at most
    2 x C x C rows); every metric is derived from that small table.
    """
    sets = test.withColumn("_set", F.lit("test"))
    if val is not None:
        sets = sets.unionByName(val.withColumn("_set", F.lit("val")))
    sc = score(sets.select("_set", "label_id", "features"), model)
    p = F.greatest(F.lit(M.EPS), F.least(F.lit(1 - M.EPS), true_class_proba("label_id")))
    conf = sc.groupBy("_set", F.col("label_id").alias("y"), F.col("prediction").alias("p")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(-F.log(p)).alias("nll"))
    rows = conf.collect()                               # <= 2 * C * C rows
    told = {}
    for part in {r["_set"] for r in rows}:
        mine = [r for r in rows if r["_set"] == part]
        told[part] = ([(int(r["y"]), int(r["p"]), int(r["cnt"])) for r in mine], sum(r["nll"] for r in mine) / sum(r["cnt"] for r in mine))
    return _metric_columns(told)


def _metric_columns(told: dict[str, tuple[list, float]]) -> dict[str, float]:
    """Log columns from each set's confusion cells and mean log-loss."""
    out: dict[str, float] = {}
    names = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "precision", "recall", "f1", "fpr")
    for s, prefix in (("test", ""), ("val", "val_")):
        if s in told:
            cells, loss = told[s]
            met = M.metrics_from_confusion_rows(cells)
            out[f"{prefix}loss"] = loss
            out.update({f"{prefix}{k}": float(met[k]) for k in names})
    return out


def _with_sets(rows: DataFrame, test: DataFrame, val: DataFrame | None) -> DataFrame:
    """Training rows of the silos and the evaluation rows in one written table, a folder each."""
    out = rows.where(F.col("part") == "train")
    for name, df in (("test", test), ("val", val)):
        if df is not None:
            out = out.unionByName(df.select("label_id", "features", F.lit(name).alias("part")), allowMissingColumns=True)
    return materialize(out.select("silo_id", "label_id", "train_label", "w_row", "features", "part"), "round-rows", ["part"])


def run_federated(spark: SparkSession, train: DataFrame, test: DataFrame, val: DataFrame | None,
                  n_features: int, n_classes: int, cfg: RunConfig, log_dir: str | None = None) -> DataFrame:
    """Train one run; returns its round log (round 0 = the zero model). One pass over training,
    validation and test rows scores the global model and takes the next round's first local
    gradients. With ``log_dir`` every round is written when it has been scored (round 0 replaces
    an earlier log of the same run), so a run that stops leaves the rounds it finished."""
    if cfg.aggregation not in R.METHODS:
        raise ValueError(f"unknown rule {cfg.aggregation!r}; known: {', '.join(R.METHODS)}")
    if cfg.attack not in R.ATTACKS:
        raise ValueError(f"attack must be one of {R.ATTACKS}, got {cfg.attack!r}")
    if cfg.rebalance not in REBALANCE:
        raise ValueError(f"rebalance must be one of {REBALANCE}, got {cfg.rebalance!r}")
    if cfg.weight not in ("examples", "raw"):
        raise ValueError(f"weight must be 'examples' or 'raw', got {cfg.weight!r}")
    rows = prepare_silo_rows(train, cfg, n_classes, spark)
    all_rows = _with_sets(rows, test, val)
    local_rows = all_rows.where(F.col("part") == "train")
    sets = ["test"] + (["val"] if val is not None else [])
    weight = "w_row" if "oversample" in cfg.rebalance else None
    # FedAvg weight per silo: post-oversampling examples (the reference) or raw local rows
    raw = ({int(r["silo_id"]): float(r["count"]) for r in local_rows.groupBy("silo_id").count().collect()}
           if cfg.weight == "raw" else None)
    cw = class_weights_of(train, n_classes) if "weights" in cfg.rebalance else None
    silos = list(range(cfg.n_silos))
    # a clean run has no attackers: its malicious fraction (logged, and the default defence
    # fraction) is 0 whatever was configured
    mal_frac = float(cfg.malicious_fraction) if cfg.attack != "none" else 0.0
    glob = LinearModel.zeros(n_features, n_classes)
    n_params = glob.flat().size
    info = {"run_name": cfg.label(), "aggregation": cfg.aggregation, "attack": cfg.attack,
            "malicious_fraction": mal_frac, "partition_alpha": float(cfg.partition_alpha),
            "model_alpha": float(cfg.model_alpha), "local_epochs": int(cfg.local_epochs), "seed": int(cfg.seed)}
    t0 = time.perf_counter()
    log: list[dict] = []

    def record(row: dict) -> None:
        log.append(row)
        if log_dir:
            one = spark.createDataFrame([tuple(row.get(f.name) for f in ROUND_SCHEMA.fields)], ROUND_SCHEMA)
            (IO.append_round_log if len(log) > 1 else IO.write_run_log)(one, log_dir)

    ended: dict = {**info, "round": 0, "elapsed_s": 0.0}  # a round's row, until its model has been scored
    for rnd in range(1, cfg.rounds + 1):
        first, told = evaluated_gradients(all_rows, glob, silos, n_features, sets, class_weights=cw, weight=weight)
        record({**ended, **_metric_columns(told), "elapsed_s": time.perf_counter() - t0 if rnd > 1 else 0.0})
        local, stats = train_local(local_rows, {s: glob for s in silos}, n_features, cfg.local_epochs,
                                   cfg.learning_rate, cfg.model_alpha, first=first, class_weights=cw, weight=weight)
        present = [s for s in silos if s in stats]
        n = len(present)
        n_mal = int(round(mal_frac * cfg.n_silos))
        upd_rows = [(s, p, float(v)) for s in present for p, v in enumerate(local[s].flat())]
        updates = spark.createDataFrame(upd_rows, "client_id int, pos int, value double")
        n_ex = {s: (raw.get(s, 0.0) if raw is not None else float(stats[s][0])) for s in present}
        clients = spark.createDataFrame(
            [(s, n_ex[s], float(stats[s][1]), int(s < n_mal)) for s in present],
            "client_id int, num_examples double, train_loss double, malicious int")
        if cfg.attack == "model_poison":
            g = spark.createDataFrame([(p, float(v)) for p, v in enumerate(glob.flat())], "pos int, value double")
            updates = R.poison_updates(updates, g, clients, cfg.poison_scale)
        f = int(round((cfg.defense_fraction if cfg.defense_fraction >= 0 else mal_frac) * n))
        trim = cfg.trim_ratio if cfg.trim_ratio >= 0 else (f / n if n else 0.0)
        ta = time.perf_counter()
        kept = mal_kept = None
        if cfg.aggregation in ("krum", "multikrum"):
            # one pairwise-distance pass: the selection (one row per client) drives both the
            # aggregate and the kept-client statistics
            sel = [r["client_id"] for r in R.krum_select(updates, f, cfg.aggregation == "multikrum")
                   .where("selected").collect()]
            kept, mal_kept = len(sel), int(sum(1 for s in sel if s < n_mal))
            chosen = spark.createDataFrame([(s,) for s in sel], "client_id int")
            agg = (updates.join(chosen, "client_id", "left_semi").groupBy("pos")
                   .agg(F.avg("value").alias("value")).collect())
        else:
            agg = R.aggregate(cfg.aggregation, updates, clients, f=f, trim_ratio=trim).collect()
        agg_time = time.perf_counter() - ta
        flat = np.zeros(n_params)
        for r in agg:
            flat[int(r["pos"])] = float(r["value"])
        glob = LinearModel.from_flat(flat, n_features, n_classes)
        wsum = sum(n_ex[s] for s in present)
        ended = {**info, "round": rnd, "clients": n, "malicious_in_round": sum(1 for s in present if s < n_mal),
                    "kept_clients": kept, "malicious_kept": mal_kept, "agg_time_s": agg_time,
                    "train_loss": sum(stats[s][1] * n_ex[s] for s in present) / wsum if wsum else 0.0,
                    "bytes_up": n * n_params * 8, "bytes_down": n * n_params * 8}
    record({**ended, **evaluate(glob, test, val), "elapsed_s": time.perf_counter() - t0 if cfg.rounds else 0.0})
    return spark.createDataFrame([tuple(r.get(f.name) for f in ROUND_SCHEMA.fields) for r in log], ROUND_SCHEMA)


def config_dict(cfg: RunConfig) -> dict:
    return asdict(cfg)
