"""Reporting over per-round run logs.

Input: a ``rounds`` table with one row per (run_name, round) and columns
``aggregation, attack, malicious_fraction, clients, f1, recall, fpr, val_macro_f1,
agg_time_s, bytes_up[, bytes_down], malicious_in_round, malicious_kept, logged_at``.
Every operator is a group-by over runs (one group = one run's rounds, bounded by the
round count), so the work is a single shuffle on ``run_name``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions.attach import with_scalars
from rampart.functions.scalar import percent_label
from rampart.operators.robust import METHODS

KRUM_FAMILY = ("krum", "multikrum")
RUN = "run_name"


def _run_window() -> Window:
    return Window.partitionBy(RUN)


def backfill_clients(rounds: DataFrame) -> DataFrame:
    """``clients`` = max over the run (round 0 logs no client count)."""
    return rounds.withColumn("clients", F.max("clients").over(_run_window()))


def elapsed(rounds: DataFrame, ts: str = "logged_at") -> DataFrame:
    """Seconds since the run's first log."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return rounds.withColumn("elapsed_s", (us - F.min(us).over(_run_window())) / F.lit(1e6))


def final_round(rounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Last row of every run (highest round)."""
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), "round")
    return rounds.groupBy(RUN).agg(F.max("round").alias("round"), last.alias("_l")).select(
        RUN, "round", *[F.col(f"_l.{c}").alias(c) for c in cols])


def best_round(rounds: DataFrame, cols: Sequence[str], by: str = "val_macro_f1") -> DataFrame:
    """Per run, among trained rounds (> 0), the row with the best ``by``; ties -> earliest round."""
    trained = rounds.where((F.col("round") > 0) & F.col(by).isNotNull())
    best = F.max_by(F.struct(F.col("round"), *[F.col(c) for c in cols]), F.struct(F.col(by), -F.col("round")))
    return trained.groupBy(RUN).agg(best.alias("_b")).select(
        RUN, F.col("_b.round").alias("round"), *[F.col(f"_b.{c}").alias(c) for c in cols])


def rounds_to_fraction(rounds: DataFrame, metric: str = "f1", frac: float = 0.95, floor_: float = 0.05) -> DataFrame:
    """First round whose metric reaches ``frac`` x the final value; NULL when final <= ``floor_``."""
    final = F.max_by(F.col(metric), "round").over(_run_window())
    r = rounds.withColumn("_final", final)
    hit = F.min(F.when(F.col(metric) >= F.lit(frac) * F.col("_final"), F.col("round")))
    return r.groupBy(RUN).agg(F.first("_final").alias("final"), hit.alias("_hit")).select(
        RUN, F.when(F.col("final") > floor_, F.col("_hit")).alias("rounds_to_95pct_final_f1"))


# Columns of the per-run summary, in report order (run keys, then final metrics).
SUMMARY_KEYS = ("aggregation", "attack", "malicious_fraction", "clients", "partition_alpha", "seed")
SUMMARY_FINAL = ("accuracy", "precision", "recall", "f1", "fpr", "loss")


def run_summary(rounds: DataFrame) -> DataFrame:
    """One row per run: final metrics, convergence, mean aggregation ms, communication MB, attackers seen/kept.

    Key and final-metric columns missing from the log (older logs, other writers) are left out.
    ``wall_time_s`` is the last logged ``elapsed_s``; logs without it derive it from ``logged_at``.
    """
    r = backfill_clients(rounds)
    if "elapsed_s" not in r.columns:
        r = elapsed(r) if "logged_at" in r.columns else r.withColumn("elapsed_s", F.lit(None).cast("double"))
    down = F.col("bytes_down") if "bytes_down" in r.columns else F.col("bytes_up")
    trained = F.col("round") > 0
    keys = [c for c in SUMMARY_KEYS if c in r.columns]
    finals = [c for c in SUMMARY_FINAL if c in r.columns]
    kept = F.col("malicious_kept") if "malicious_kept" in r.columns else F.lit(None).cast("double")
    r = r.withColumn("_final_f1", F.max_by("f1", "round").over(_run_window()))
    last = F.max_by(F.struct(*keys, *finals, "elapsed_s"), "round")
    g = r.groupBy(RUN).agg(
        last.alias("_l"),
        F.max("round").alias("rounds"),
        F.min(F.when(F.col("f1") >= F.lit(0.95) * F.col("_final_f1"), F.col("round"))).alias("_hit"),
        (F.avg(F.when(trained, F.col("agg_time_s"))) * 1000).alias("mean_agg_time_ms"),
        (F.sum(F.when(trained, F.col("bytes_up") + down)) / F.lit(1e6)).alias("total_comm_MB"),
        F.avg(F.when(trained, F.col("malicious_in_round"))).alias("malicious_in_round"),
        F.avg(F.when(trained, kept)).alias("malicious_kept"),
    )
    return g.select(
        RUN,
        *[F.col(f"_l.{c}").alias(c) for c in keys],
        "rounds",
        *[F.col(f"_l.{c}").alias(c) for c in finals],
        F.when(F.col("_l.f1") > 0.05, F.col("_hit")).alias("rounds_to_95pct_final_f1"),
        "mean_agg_time_ms", "total_comm_MB",
        F.col("_l.elapsed_s").alias("wall_time_s"),
        "malicious_in_round", "malicious_kept",
    )


def group_report(summary: DataFrame, keys: Sequence[str] = ("clients", "aggregation"),
                 clean_only: bool = True) -> DataFrame:
    """Mean and sample std of f1/fpr/recall plus mean convergence, aggregation ms and MB per group
    (over the runs without attackers, unless ``clean_only`` is off)."""
    if clean_only:
        summary = summary.where(F.col("attack") == "none")
    aggs = []
    for m in ("f1", "fpr", "recall"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    aggs += [F.avg("rounds_to_95pct_final_f1").alias("rounds_to_95_mean"),
             F.avg("mean_agg_time_ms").alias("agg_ms_mean"), F.avg("total_comm_MB").alias("comm_MB_mean"),
             F.count(F.lit(1)).alias("runs")]
    return summary.groupBy(*keys).agg(*aggs)


def fraction_pivot(summary: DataFrame, attack: str, metric: str, clients: int,
                   methods: Sequence[str] = METHODS) -> DataFrame:
    """malicious fraction x aggregation table of a metric (clean runs + one attack, one client count):
    per rule the mean over runs (column named after the rule) and its sample std (``<rule>_std``,
    NULL for a single run); ``mean_std_text`` renders the pair as the report text."""
    sub = summary.where((F.col("clients") == clients) & F.col("attack").isin("none", attack))
    p = sub.groupBy("malicious_fraction").pivot("aggregation", list(methods)).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    p = p.select("malicious_fraction", *[F.col(f"{m}_mean").alias(m) for m in methods],
                 *[F.col(f"{m}_std") for m in methods])
    return p.withColumn("malicious", percent_label("malicious_fraction"))


def attack_curve(summary: DataFrame, attack: str, clients: int,
                 metrics: Sequence[str] = ("f1", "recall", "fpr")) -> DataFrame:
    """Per rule and attacker fraction: mean and sample std (0 for a single run) of each metric, over
    the runs of one silo count under ``attack`` plus the clean runs (the 0 % point)."""
    summary = summary.where((F.col("clients") == clients) & F.col("attack").isin("none", attack))
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return summary.groupBy("aggregation", "malicious_fraction").agg(*aggs)


def convergence_curve(rounds: DataFrame, metric: str = "f1") -> DataFrame:
    clean = backfill_clients(rounds).where(F.col("attack") == "none")
    return clean.groupBy("aggregation", "clients", "round").agg(F.avg(metric).alias(f"{metric}_mean"))


def overhead(summary: DataFrame, clean_only: bool = True) -> DataFrame:
    """Mean aggregation time and communication per rule (runs without attackers)."""
    if clean_only:
        summary = summary.where(F.col("attack") == "none")
    return summary.groupBy("aggregation").agg(F.avg("mean_agg_time_ms").alias("agg_ms_mean"),
                                              F.avg("total_comm_MB").alias("comm_MB_mean"))


def attackers_admitted(summary: DataFrame, attack: str) -> DataFrame:
    """Attackers per round and attackers admitted by the Krum family, per rule and fraction, under ``attack``."""
    k = summary.where(F.col("aggregation").isin(*KRUM_FAMILY) & (F.col("attack") == attack))
    return k.groupBy("aggregation", "malicious_fraction").agg(
        F.avg("malicious_in_round").alias("malicious_in_round"), F.avg("malicious_kept").alias("malicious_kept"))


def select_best(candidates: DataFrame, keys: Sequence[str], choice: str, metric: str) -> DataFrame:
    """Per group, the ``choice`` with the highest ``metric`` (ties -> smallest choice).

    One window per group over its candidates (e.g. the regularisation values of a sweep).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), F.asc(choice))
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*keys, choice, metric)


# Metrics a run log needs to enter the benchmark (balanced accuracy, macro-F1 of the
# trained rounds, validation macro-F1 for best-round selection).
BENCH_REQUIRED = ("balanced_accuracy", "macro_f1", "val_macro_f1")


def eligible_runs(rounds: DataFrame, required: Sequence[str] = BENCH_REQUIRED) -> DataFrame:
    """Clean runs (last row attack = 'none') that have trained rounds and the required metrics.

    A required column absent from the log's schema makes every run ineligible.
    """
    last = final_round(rounds, ["attack"])
    if any(c not in rounds.columns for c in required):
        return last.where(F.lit(False)).select(RUN, F.col("round").alias("last_round"))
    trained = rounds.where(F.col("round") > 0).groupBy(RUN).agg(
        *[F.count(c).alias(f"_n_{c}") for c in required])
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.col(f"_n_{c}") > 0)
    return last.where(F.col("attack") == "none").join(trained, RUN).where(ok).select(RUN, F.col("round").alias("last_round"))


def model_name(aggregation: Column, clients: Column, partition_alpha: Column, rounds: Column) -> Column:
    """``Federated logistic_sgd (<agg>, <n> clients, IID|non-IID a=<alpha>, <r> rounds)``; '?' for unknown n."""
    n = F.coalesce(clients.cast("string"), F.lit("?"))
    dist = F.when(F.coalesce(partition_alpha, F.lit(0.0)) <= 0, F.lit("IID")).otherwise(
        F.concat(F.lit("non-IID a="), alpha_text(partition_alpha)))
    return F.format_string("Federated logistic_sgd (%s, %s clients, %s, %d rounds)", aggregation, n, dist, rounds)


def alpha_text(x: Column) -> Column:
    """Six significant digits without trailing zeros, in plain or exponent form as Python's ``g``
    (``1.0`` -> ``1``, ``1e-05``), from the digits and exponent of the scientific form."""
    sci = F.format_string("%.5e", x.cast("double"))
    exp = F.split_part(sci, F.lit("e"), F.lit(2)).cast("int")
    digits = F.replace(F.split_part(sci, F.lit("e"), F.lit(1)), F.lit("."), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"\.?0*$", "")
    large = F.concat(F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2), F.lit("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    power = F.concat(strip(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))), F.lit("e"),
                     F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exp).cast("string"))
    return F.when((exp >= -4) & (exp < 0), strip(small)).when((exp >= 0) & (exp < 6), strip(large)).otherwise(power)


# fixed values
BENCH_COLS = ("Model", "Source", "Split", "Selection", "Round", "Accuracy", "Balanced Accuracy", "Macro F1",
              "Weighted F1")


def benchmark_rows(rounds: DataFrame, source: str = "federated", required: Sequence[str] = BENCH_REQUIRED) -> DataFrame:
    """Final and best-by-validation test rows of every eligible clean run, in the fixed 9-column layout."""
    metric_map = {"Accuracy": "accuracy", "Balanced Accuracy": "balanced_accuracy", "Macro F1": "macro_f1",
                  "Weighted F1": "weighted_f1"}
    present = [c for c in metric_map.values() if c in rounds.columns]
    elig = eligible_runs(rounds, required)
    r = backfill_clients(rounds).join(elig.select(RUN), RUN, "left_semi")
    alpha = F.col("partition_alpha") if "partition_alpha" in r.columns else F.lit(None).cast("double")
    r = r.withColumn("_alpha", alpha)
    fin = final_round(r, ["aggregation", "clients", "_alpha", *present]).withColumn("Selection", F.lit("final"))
    best = best_round(r, ["aggregation", "clients", "_alpha", *present]).withColumn("Selection", F.lit("best_val_macro_f1"))
    last = final_round(r, ["aggregation", "clients", "_alpha"]).select(RUN, F.col("round").alias("_last"))

    def shape(df: DataFrame) -> DataFrame:
        d = df.join(last, RUN)
        return d.select(
            model_name(F.col("aggregation"), F.col("clients"), F.col("_alpha"), F.col("_last")).alias("Model"),
            F.lit(source).alias("Source"), F.lit("test").alias("Split"), "Selection",
            F.col("round").cast("int").alias("Round"),
            *[(F.col(v) if v in present else F.lit(None).cast("double")).alias(k) for k, v in metric_map.items()])

    return shape(fin).unionByName(shape(best))


def legacy_rows(results: DataFrame) -> DataFrame:
    """Rows of the legacy comparison table (``read_results_csv``) in the fixed layout: test metrics
    without a selection or round."""
    named = {"Accuracy": "Test Accuracy", "Balanced Accuracy": "Test Balanced Accuracy", "Macro F1": "Test Macro F1", "Weighted F1": "Test Weighted F1"}
    return results.select("Model", F.lit("legacy").alias("Source"), F.lit("test").alias("Split"), F.lit(None).cast("string").alias("Selection"),
                          F.lit(None).cast("int").alias("Round"), *[F.col(f"`{v}`").cast("double").alias(k) for k, v in named.items()])


def centralized_rows(results: DataFrame, source: str = "checkpoint3") -> DataFrame:
    """Rows of a centralised run (``alpha_sweep``, ``forest_baseline``, ``gbt_baseline``) in the fixed
    layout, its split in lower case."""
    named = {"Accuracy": "accuracy", "Balanced Accuracy": "balanced_accuracy", "Macro F1": "macro_f1", "Weighted F1": "weighted_f1"}
    return results.select(F.col("model").alias("Model"), F.lit(source).alias("Source"), F.lower("split").alias("Split"), F.lit(None).cast("string").alias("Selection"),
                          F.lit(None).cast("int").alias("Round"), *[F.col(v).cast("double").alias(k) for k, v in named.items()])


def union_benchmarks(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of benchmark sources into the fixed layout; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*BENCH_COLS)


def baseline_overlay(summary: DataFrame, baseline: DataFrame, metrics: Sequence[str] = ("f1",), by: str = "f1") -> DataFrame:
    """Every run's final metrics next to those of the best baseline test row: the one with the
    largest ``by``, whatever metric is shown (a one-row aggregate, attached as scalars)."""
    test = baseline.where(F.col("split") == "test") if "split" in baseline.columns else baseline
    best = test.where(F.col(by).isNotNull()).agg(F.max_by(F.struct(RUN, *metrics), F.struct(by, RUN)).alias("_b")).select(
        F.col(f"_b.{RUN}").alias("baseline_run"), *[F.col(f"_b.{m}").alias(f"baseline_{m}") for m in metrics])
    return with_scalars(summary, best).withColumns({f"delta_{m}": F.col(m) - F.col(f"baseline_{m}") for m in metrics})


def join_round_stats(metrics: DataFrame, stats: DataFrame) -> DataFrame:
    """Round metrics left-joined with client statistics on (run, round) (round 0 has none)."""
    return metrics.join(stats, on=[RUN, "round"], how="left")
