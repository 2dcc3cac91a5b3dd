"""Registered queries: reporting over per-round run logs (F-rounds fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import report as RP
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.session import scratch_path
from rampart.sources import io as IO
from rampart.sources import tables as T


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounds(spark, sf):
    return T.round_logs(spark, sf)


def _summary(spark, sf):
    return RP.run_summary(_rounds(spark, sf))


def _round_doubles(df, keep=()):
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def q_final(spark, sf):
    return _round_doubles(RP.final_round(_rounds(spark, sf), ["aggregation", "f1", "recall", "fpr"]))


def q_best(spark, sf):
    return _round_doubles(RP.best_round(_rounds(spark, sf), ["f1", "val_macro_f1"]))


def q_to95(spark, sf):
    return RP.rounds_to_fraction(_rounds(spark, sf))


def q_backfill(spark, sf):
    return RP.backfill_clients(_rounds(spark, sf)).select("run_name", "round", "clients")


def q_elapsed(spark, sf):
    return RP.elapsed(_rounds(spark, sf)).select("run_name", "round", r6("elapsed_s").alias("elapsed_s"))


def q_summary(spark, sf):
    return _round_doubles(_summary(spark, sf), keep=("malicious_fraction",))


def q_group(spark, sf):
    return _round_doubles(RP.group_report(_summary(spark, sf)))


def q_pivot(spark, sf):
    return _round_doubles(RP.fraction_pivot(_summary(spark, sf), "label_flip", "f1", 10), keep=("malicious_fraction",))


def q_attack_curve(spark, sf):
    return _round_doubles(RP.attack_curve(_summary(spark, sf), "label_flip", 10), keep=("malicious_fraction",))


def q_convergence(spark, sf):
    return _round_doubles(RP.convergence_curve(_rounds(spark, sf)))


def q_overhead(spark, sf):
    return _round_doubles(RP.overhead(_summary(spark, sf)))


def q_admitted(spark, sf):
    return _round_doubles(RP.attackers_admitted(_summary(spark, sf), "label_flip"), keep=("malicious_fraction",))


def q_select_best(spark, sf):
    fin = RP.final_round(_rounds(spark, sf), ["attack", "aggregation", "val_macro_f1"])
    return _round_doubles(RP.select_best(fin, ["attack"], "aggregation", "val_macro_f1"))


def q_eligible(spark, sf):
    # the fixture logs f1 as its macro-F1 stand-in and no balanced accuracy
    return RP.eligible_runs(_rounds(spark, sf), required=("f1", "val_macro_f1"))


def q_benchmark(spark, sf):
    r = _rounds(spark, sf).withColumn("macro_f1", F.col("f1"))
    fed = RP.benchmark_rows(r, required=("macro_f1", "val_macro_f1"))
    summ = _summary(spark, sf).where(F.col("attack") == "none")
    per_method = summ.groupBy("aggregation").agg(F.avg("f1").alias("Macro F1")).select(
        F.concat(F.lit("Federated mean over runs ("), F.col("aggregation"), F.lit(")")).alias("Model"),
        F.lit("summary").alias("Source"), F.lit("test").alias("Split"), "Macro F1")
    return _round_doubles(RP.union_benchmarks([fed, per_method]))


def q_benchmark_sources(spark, sf):
    """Legacy results read back from a CSV, a legacy file that is missing, and centralised rows."""
    import uuid

    r = _rounds(spark, sf)
    path = scratch_path(spark, f"legacy-{uuid.uuid4().hex}")
    best = r.groupBy("run_name").agg(F.max("f1").alias("f"))
    IO.write_csv(best.select(F.col("run_name").alias("Model"), F.col("f").alias("Test Accuracy"), (F.col("f") / 2).alias("Test Balanced Accuracy"),
                             (F.col("f") / 4).alias("Test Macro F1"), (F.col("f") / 8).alias("Test Weighted F1")), path, single_file=True)
    central = r.groupBy(F.col("aggregation").alias("model")).agg(F.avg("f1").alias("accuracy")).select(
        "model", F.lit("Test").alias("split"), "accuracy", (F.col("accuracy") / 2).alias("balanced_accuracy"), (F.col("accuracy") / 4).alias("macro_f1"),
        (F.col("accuracy") / 8).alias("weighted_f1"))
    legacy, missing = (RP.legacy_rows(IO.read_results_csv(spark, p)) for p in (path, f"{path}-missing"))
    return _round_doubles(RP.union_benchmarks([legacy, missing, RP.centralized_rows(central)]))


def q_round_join(spark, sf):
    r = _rounds(spark, sf)
    metrics = r.select("run_name", "round", "f1")
    stats = r.where(F.col("round") > 0).select("run_name", "round", "clients", "agg_time_s", "bytes_up")
    return _round_doubles(RP.join_round_stats(metrics, stats))


def q_overlay(spark, sf):
    s = _summary(spark, sf)
    o = RP.baseline_overlay(s.select("run_name", "f1"), s.where(F.col("attack") == "none").select("run_name", "f1"))
    return _round_doubles(o)


def q_overlay_metrics(spark, sf):
    """All overlaid metrics come from the baseline test row of the best f1."""
    s = _summary(spark, sf).select("run_name", "f1", "attack", (F.lit(1.0) - F.col("f1") / 2).alias("fpr"))
    base = s.where(F.col("attack") == "none").drop("attack")
    base = base.withColumn("split", F.lit("test")).unionByName(base.withColumn("split", F.lit("val")).withColumn("f1", F.col("f1") + 1))
    return _round_doubles(RP.baseline_overlay(s.drop("attack"), base, ("f1", "fpr")))


QUERIES = {
    "report_final_round": q_final,
    "report_best_round": q_best,
    "report_rounds_to_95": q_to95,
    "report_clients_backfill": q_backfill,
    "report_elapsed": q_elapsed,
    "report_run_summary": q_summary,
    "report_group": q_group,
    "report_fraction_pivot": q_pivot,
    "report_attack_curve": q_attack_curve,
    "report_convergence": q_convergence,
    "report_overhead": q_overhead,
    "report_attackers_admitted": q_admitted,
    "report_select_best": q_select_best,
    "report_eligible_runs": q_eligible,
    "report_benchmark_union": q_benchmark,
    "report_benchmark_sources": q_benchmark_sources,
    "report_round_stats_join": q_round_join,
    "report_baseline_overlay": q_overlay,
    "report_baseline_overlay_metrics": q_overlay_metrics,
}

_RB = ("rb", """SELECT *, max(clients) OVER (PARTITION BY run_name) AS clients_b,
       (epoch_us(logged_at) - min(epoch_us(logged_at)) OVER (PARTITION BY run_name)) / 1e6 AS elapsed_s,
       arg_max(f1, round) OVER (PARTITION BY run_name) AS final_f1 FROM rounds""")
_SUMM = ("summ", """SELECT run_name, arg_max(aggregation, round) AS aggregation, arg_max(attack, round) AS attack,
       arg_max(malicious_fraction, round) AS malicious_fraction, arg_max(clients_b, round) AS clients,
       max(round) AS rounds, arg_max(f1, round) AS f1, arg_max(recall, round) AS recall, arg_max(fpr, round) AS fpr,
       CASE WHEN arg_max(f1, round) > 0.05 THEN min(round) FILTER (WHERE f1 >= 0.95e0 * final_f1) END
         AS rounds_to_95pct_final_f1,
       avg(agg_time_s) FILTER (WHERE round > 0) * 1000 AS mean_agg_time_ms,
       sum(bytes_up + bytes_up) FILTER (WHERE round > 0) / 1e6 AS total_comm_MB,
       arg_max(elapsed_s, round) AS wall_time_s,
       avg(malicious_in_round) FILTER (WHERE round > 0) AS malicious_in_round,
       avg(malicious_kept) FILTER (WHERE round > 0) AS malicious_kept
FROM rb GROUP BY run_name""")
_S = [_RB, _SUMM]


def _r(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_BENCH = ("br", """
SELECT r.run_name, r.round, r.f1, r.val_macro_f1, r.aggregation, r.clients_b, l.last_round
FROM rb r JOIN (SELECT run_name, max(round) AS last_round, arg_max(attack, round) AS last_attack FROM rounds GROUP BY 1) l
  USING (run_name)
WHERE l.last_attack = 'none'
  AND run_name IN (SELECT run_name FROM rounds WHERE round > 0 GROUP BY 1 HAVING count(f1) > 0 AND count(val_macro_f1) > 0)""")

_MODEL = ("'Federated logistic_sgd (' || aggregation || ', ' || coalesce(CAST(clients_b AS VARCHAR), '?') || "
          "' clients, IID, ' || CAST(last_round AS VARCHAR) || ' rounds)'")

ORACLE = {
    "report_final_round": with_fixtures("rounds", f"""
SELECT run_name, max(round) AS round, arg_max(aggregation, round) AS aggregation,
       round(arg_max(f1, round), 6) AS f1, round(arg_max(recall, round), 6) AS recall,
       round(arg_max(fpr, round), 6) AS fpr FROM rounds GROUP BY run_name"""),
    "report_best_round": with_fixtures("rounds", """
SELECT run_name, round, round(f1, 6) AS f1, round(val_macro_f1, 6) AS val_macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY val_macro_f1 DESC, round) AS rk
  FROM rounds WHERE round > 0 AND val_macro_f1 IS NOT NULL) t WHERE rk = 1"""),
    "report_rounds_to_95": with_fixtures("rounds", """
SELECT run_name, CASE WHEN any_value(final_f1) > 0.05 THEN min(round) FILTER (WHERE f1 >= 0.95e0 * final_f1) END
  AS rounds_to_95pct_final_f1 FROM rb GROUP BY run_name""", [_RB]),
    "report_clients_backfill": with_fixtures("rounds", "SELECT run_name, round, clients_b AS clients FROM rb", [_RB]),
    "report_elapsed": with_fixtures("rounds", "SELECT run_name, round, round(elapsed_s, 6) AS elapsed_s FROM rb", [_RB]),
    "report_run_summary": with_fixtures("rounds", f"""
SELECT run_name, aggregation, attack, malicious_fraction, clients, rounds,
       {_r(['f1', 'recall', 'fpr'])}, rounds_to_95pct_final_f1,
       {_r(['mean_agg_time_ms', 'total_comm_MB', 'wall_time_s', 'malicious_in_round', 'malicious_kept'])}
FROM summ""", _S),
    "report_group": with_fixtures("rounds", """
SELECT clients, aggregation,
       round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std,
       round(avg(fpr), 6) AS fpr_mean, round(stddev_samp(fpr), 6) AS fpr_std,
       round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std,
       round(avg(rounds_to_95pct_final_f1), 6) AS rounds_to_95_mean,
       round(avg(mean_agg_time_ms), 6) AS agg_ms_mean, round(avg(total_comm_MB), 6) AS comm_MB_mean,
       count(*) AS runs
FROM summ WHERE attack = 'none' GROUP BY clients, aggregation""", _S),
    "report_fraction_pivot": with_fixtures("rounds", """
SELECT malicious_fraction,
       round(avg(f1) FILTER (WHERE aggregation = 'fedavg'), 6) AS fedavg,
       round(avg(f1) FILTER (WHERE aggregation = 'median'), 6) AS median,
       round(avg(f1) FILTER (WHERE aggregation = 'trimmed_mean'), 6) AS trimmed_mean,
       round(avg(f1) FILTER (WHERE aggregation = 'krum'), 6) AS krum,
       round(avg(f1) FILTER (WHERE aggregation = 'multikrum'), 6) AS multikrum,
       round(stddev_samp(f1) FILTER (WHERE aggregation = 'fedavg'), 6) AS fedavg_std,
       round(stddev_samp(f1) FILTER (WHERE aggregation = 'median'), 6) AS median_std,
       round(stddev_samp(f1) FILTER (WHERE aggregation = 'trimmed_mean'), 6) AS trimmed_mean_std,
       round(stddev_samp(f1) FILTER (WHERE aggregation = 'krum'), 6) AS krum_std,
       round(stddev_samp(f1) FILTER (WHERE aggregation = 'multikrum'), 6) AS multikrum_std,
       CAST(CAST(round_even(malicious_fraction * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS malicious
FROM summ WHERE clients = 10 AND attack IN ('none', 'label_flip') GROUP BY malicious_fraction""", _S),
    "report_attack_curve": with_fixtures("rounds", "SELECT aggregation, malicious_fraction, " + ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0.0e0), 6) AS {m}_std"
        for m in ("f1", "recall", "fpr")) + " FROM summ WHERE clients = 10 AND attack IN ('none', 'label_flip')"
        " GROUP BY aggregation, malicious_fraction", _S),
    "report_convergence": with_fixtures("rounds", """
SELECT aggregation, clients_b AS clients, round, round(avg(f1), 6) AS f1_mean FROM rb WHERE attack = 'none'
GROUP BY aggregation, clients_b, round""", [_RB]),
    "report_overhead": with_fixtures("rounds", """
SELECT aggregation, round(avg(mean_agg_time_ms), 6) AS agg_ms_mean, round(avg(total_comm_MB), 6) AS comm_MB_mean
FROM summ WHERE attack = 'none' GROUP BY aggregation""", _S),
    "report_attackers_admitted": with_fixtures("rounds", """
SELECT aggregation, malicious_fraction, round(avg(malicious_in_round), 6) AS malicious_in_round,
       round(avg(malicious_kept), 6) AS malicious_kept
FROM summ WHERE aggregation IN ('krum', 'multikrum') AND attack = 'label_flip'
GROUP BY aggregation, malicious_fraction""", _S),
    "report_select_best": with_fixtures("rounds", """
SELECT attack, aggregation, round(val_macro_f1, 6) AS val_macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY attack ORDER BY val_macro_f1 DESC, aggregation) AS rk FROM (
    SELECT run_name, arg_max(attack, round) AS attack, arg_max(aggregation, round) AS aggregation,
           arg_max(val_macro_f1, round) AS val_macro_f1 FROM rounds GROUP BY run_name) f) t WHERE rk = 1"""),
    "report_eligible_runs": with_fixtures("rounds", """
SELECT run_name, max(round) AS last_round FROM rounds GROUP BY run_name
HAVING arg_max(attack, round) = 'none'
   AND run_name IN (SELECT run_name FROM rounds WHERE round > 0 GROUP BY 1 HAVING count(f1) > 0 AND count(val_macro_f1) > 0)"""),
    "report_benchmark_union": with_fixtures("rounds", f"""
SELECT {_MODEL} AS "Model", 'federated' AS "Source", 'test' AS "Split", 'final' AS "Selection",
       CAST(round AS INTEGER) AS "Round", CAST(NULL AS DOUBLE) AS "Accuracy", CAST(NULL AS DOUBLE) AS "Balanced Accuracy",
       round(f1, 6) AS "Macro F1", CAST(NULL AS DOUBLE) AS "Weighted F1"
FROM br WHERE round = last_round
UNION ALL
SELECT {_MODEL}, 'federated', 'test', 'best_val_macro_f1', CAST(round AS INTEGER), NULL, NULL, round(f1, 6), NULL FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY val_macro_f1 DESC, round) AS rk
  FROM br WHERE round > 0 AND val_macro_f1 IS NOT NULL) t WHERE rk = 1
UNION ALL
SELECT 'Federated mean over runs (' || aggregation || ')', 'summary', 'test', NULL, NULL, NULL, NULL,
       round(avg(f1), 6), NULL FROM summ WHERE attack = 'none' GROUP BY aggregation""", _S + [_BENCH]),
    "report_benchmark_sources": with_fixtures("rounds", """
SELECT m AS "Model", s AS "Source", 'test' AS "Split", CAST(NULL AS VARCHAR) AS "Selection", CAST(NULL AS INTEGER) AS "Round", round(f, 6) AS "Accuracy",
       round(f / 2, 6) AS "Balanced Accuracy", round(f / 4, 6) AS "Macro F1", round(f / 8, 6) AS "Weighted F1"
FROM (SELECT run_name AS m, 'legacy' AS s, max(f1) AS f FROM rounds GROUP BY 1
      UNION ALL SELECT aggregation, 'checkpoint3', avg(f1) FROM rounds GROUP BY 1) x"""),
    "report_round_stats_join": with_fixtures("rounds", """
SELECT m.run_name, m.round, round(m.f1, 6) AS f1, s.clients, round(s.agg_time_s, 6) AS agg_time_s, s.bytes_up
FROM rounds m LEFT JOIN (SELECT * FROM rounds WHERE round > 0) s ON m.run_name = s.run_name AND m.round = s.round"""),
    "report_baseline_overlay_metrics": with_fixtures("rounds", """
SELECT s.run_name, round(s.f1, 6) AS f1, round(1 - s.f1 / 2, 6) AS fpr, b.run_name AS baseline_run, round(b.f1, 6) AS baseline_f1,
       round(1 - b.f1 / 2, 6) AS baseline_fpr, round(s.f1 - b.f1, 6) AS delta_f1, round(b.f1 / 2 - s.f1 / 2, 6) AS delta_fpr
FROM summ s, (SELECT run_name, f1 FROM summ WHERE attack = 'none' ORDER BY f1 DESC, run_name DESC LIMIT 1) b""", _S),
    "report_baseline_overlay": with_fixtures("rounds", """
SELECT s.run_name, round(s.f1, 6) AS f1, b.run_name AS baseline_run, round(b.f1, 6) AS baseline_f1,
       round(s.f1 - b.f1, 6) AS delta_f1
FROM summ s, (SELECT run_name, f1 FROM summ WHERE attack = 'none' ORDER BY f1 DESC, run_name DESC LIMIT 1) b""", _S),
}
