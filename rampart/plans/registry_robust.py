"""Registered queries: robust aggregation, attacks, parameter layout (F-updates fixture)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions.attach import expand_values, with_scalars
from rampart.operators import robust as R
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.session import materialize
from rampart.sources import tables as T

F_DEF = 2          # assumed attacker count for the Krum family (= round(0.2 * 10))
TRIM = 0.2
FLAG_FRACTION = 0.3
STUDY_FRACTIONS = (0.0, 0.1, 0.2, 0.3, 0.4)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _u(spark, sf):
    return T.client_updates(spark, sf)


def q_fedavg(spark: SparkSession, sf: str) -> DataFrame:
    out = R.fedavg(_u(spark, sf), T.client_info(spark, sf))
    return out.select("pos", r6("value").alias("value"))


def q_median(spark, sf):
    return R.coordinate_median(_u(spark, sf)).select("pos", r6("value").alias("value"))


def q_trimmed(spark, sf):
    return R.trimmed_mean(_u(spark, sf), TRIM).select("pos", r6("value").alias("value"))


def q_krum_scores(spark, sf):
    s = R.krum_scores(_u(spark, sf), F_DEF)
    return s.select("client_id", "f_used", r6("score").alias("score"))


def q_krum(spark, sf):
    return R.krum(_u(spark, sf), F_DEF).select("pos", r6("value").alias("value"))


def q_multikrum(spark, sf):
    return R.krum(_u(spark, sf), F_DEF, multi=True).select("pos", r6("value").alias("value"))


def q_multikrum_select(spark, sf):
    return R.krum_select(_u(spark, sf), F_DEF, multi=True).select("client_id", "selected")


def q_train_loss(spark, sf):
    return R.weighted_train_loss(T.client_info(spark, sf)).select(r6("train_loss").alias("train_loss"))


def q_round_stats(spark, sf):
    u = _u(spark, sf)
    sel = R.krum_select(u, F_DEF, multi=True)
    return R.round_stats(u, T.client_info(spark, sf), sel)


def q_poison(spark, sf):
    p = R.poison_updates(_u(spark, sf), T.global_params(spark, sf), T.client_info(spark, sf), T.POISON_SCALE)
    return p.select("client_id", "pos", r6("value").alias("value"))


def q_flags(spark, sf):
    c = T.client_info(spark, sf).drop("malicious")
    return R.mark_malicious(c, FLAG_FRACTION).select("client_id", "malicious")


def q_label_flip(spark, sf):
    w = T.wide(spark, sf).withColumn("malicious", (F.col("label_id") < 2).cast("int"))
    return R.flip_labels(w, 10).select("row_id", "label_id", "train_label")


def q_flatten(spark, sf):
    u = _u(spark, sf)
    coef = u.select(F.col("client_id").alias("class"), F.col("pos").alias("feature"), "value")
    inter = u.groupBy(F.col("client_id").alias("class")).agg(F.avg("value").alias("value"))
    p = R.flatten_params(coef, inter, T.N_WIDE, 10)
    return p.select(F.col("pos").cast("int").alias("pos"), r6("value").alias("value"))


def attack_study(updates: DataFrame, clients: DataFrame, gparams: DataFrame, fractions, scale: float,
                 spark: SparkSession, write_inputs: bool = True) -> DataFrame:
    """Every aggregation rule under model poisoning at every malicious fraction, in one job.

    The fractions are a literal array: every client / update / parameter row is expanded
    over it by a generator (len(fractions) copies), no join with a literal table.
    Returns ``(aggregation, malicious_fraction, kept, err)``: err = L2 distance of the
    aggregate to the clean global parameters.
    """
    # the three inputs are small derived tables (clients x params); write them once to the
    # shared checkpoint folder so the 25 configurations below do not rescan the source for
    # every branch (computed once, unlike an RDD checkpoint, and safe from executor loss)
    if write_inputs:
        updates, clients, gparams = (materialize(updates, "study-updates"), materialize(clients, "study-clients"),
                                     materialize(gparams, "study-global"))
    fr = [float(x) for x in fractions]
    n = clients.agg(F.count(F.lit(1)).alias("_n"))
    cl = with_scalars(expand_values(clients, "malicious_fraction", fr, "double"), n)
    f_col = R.num_malicious(F.col("malicious_fraction"), F.col("_n"))
    cl = cl.withColumn("malicious", (F.col("client_id") < f_col).cast("int")).withColumn("f_def", f_col)
    keys = ["malicious_fraction"]
    up = R.poison_updates(expand_values(updates, "malicious_fraction", fr, "double"),
                          expand_values(gparams, "malicious_fraction", fr, "double"), cl, scale, keys)
    up = up.join(cl.select(*keys, "client_id", "f_def", (F.col("f_def") / F.col("_n")).alias("trim")),
                 on=keys + ["client_id"])
    outs = []
    for m in R.METHODS:
        agg = R.aggregate(m, up, cl, f="f_def", trim_ratio="trim", keys=keys)
        outs.append(agg.withColumn("aggregation", F.lit(m)))
    allagg = outs[0]
    for o in outs[1:]:
        allagg = allagg.unionByName(o)
    g = gparams.select("pos", F.col("value").alias("_g"))
    return (
        allagg.join(g, on="pos")
        .groupBy("aggregation", "malicious_fraction")
        .agg(F.sqrt(F.sum((F.col("value") - F.col("_g")) ** 2)).alias("err"))
    )


def q_attack_study(spark, sf):
    # one pass over the embeddings, written once; updates, clients and global parameters derive from it
    st = materialize(T.client_stats(spark, sf), "study-client-stats")
    s = attack_study(T.updates_of(st), T.client_info_of(st), T.global_params_of(st),
                     STUDY_FRACTIONS, T.POISON_SCALE, spark, write_inputs=False)
    return s.select("aggregation", "malicious_fraction", r6("err").alias("err"))


QUERIES = {
    "robust_fedavg": q_fedavg,
    "robust_median": q_median,
    "robust_trimmed_mean": q_trimmed,
    "robust_krum_scores": q_krum_scores,
    "robust_krum": q_krum,
    "robust_multikrum": q_multikrum,
    "robust_multikrum_select": q_multikrum_select,
    "robust_train_loss": q_train_loss,
    "robust_round_stats": q_round_stats,
    "attack_model_poison": q_poison,
    "attack_malicious_flags": q_flags,
    "attack_label_flip": q_label_flip,
    "params_flatten": q_flatten,
    "robust_attack_study": q_attack_study,
}

_KRUM_CTES = [
    ("nn", "SELECT count(DISTINCT client_id) AS n, greatest(0, least(2, (count(DISTINCT client_id) - 3) // 2)) AS f FROM updates"),
    ("pd", "SELECT a.client_id AS c1, b.client_id AS c2, sum((a.value - b.value) * (a.value - b.value)) AS d "
           "FROM updates a JOIN updates b ON a.pos = b.pos AND a.client_id <> b.client_id GROUP BY 1, 2"),
    ("rk", "SELECT c1, c2, d, row_number() OVER (PARTITION BY c1 ORDER BY d, c2) AS r FROM pd"),
    ("sc", "SELECT c1 AS client_id, sum(d) AS score FROM rk, nn WHERE r <= greatest(1, n - f - 2) GROUP BY c1"),
    ("sel", "SELECT client_id, score, row_number() OVER (ORDER BY score, client_id) AS r FROM sc"),
]

ORACLE = {
    "robust_fedavg": with_fixtures(["updates", "clients"], """
SELECT u.pos, round(sum(c.num_examples * u.value) / sum(c.num_examples), 6) AS value
FROM updates u JOIN clients c USING (client_id) GROUP BY u.pos"""),
    "robust_median": with_fixtures("updates", "SELECT pos, round(median(value), 6) AS value FROM updates GROUP BY pos"),
    "robust_trimmed_mean": with_fixtures("updates", """
SELECT pos, round(avg(value), 6) AS value FROM (
  SELECT pos, value, row_number() OVER (PARTITION BY pos ORDER BY value, client_id) AS rn,
         count(*) OVER (PARTITION BY pos) AS n FROM updates) t
WHERE rn > greatest(0, least(CAST(floor(0.2 * n + 1e-9) AS INTEGER), (n - 1) // 2))
  AND rn <= n - greatest(0, least(CAST(floor(0.2 * n + 1e-9) AS INTEGER), (n - 1) // 2))
GROUP BY pos"""),
    "robust_krum_scores": with_fixtures("updates", """
SELECT client_id, CAST(f AS INTEGER) AS f_used, round(score, 6) AS score FROM sc, nn""", _KRUM_CTES),
    "robust_krum": with_fixtures("updates", """
SELECT pos, round(avg(value), 6) AS value FROM updates
WHERE client_id IN (SELECT client_id FROM sel WHERE r <= 1) GROUP BY pos""", _KRUM_CTES),
    "robust_multikrum": with_fixtures("updates", """
SELECT pos, round(avg(value), 6) AS value FROM updates
WHERE client_id IN (SELECT client_id FROM sel, nn WHERE r <= greatest(1, least(n - f, n))) GROUP BY pos""", _KRUM_CTES),
    "robust_multikrum_select": with_fixtures("updates", """
SELECT client_id, r <= greatest(1, least(n - f, n)) AS selected FROM sel, nn""", _KRUM_CTES),
    "robust_train_loss": with_fixtures("clients", """
SELECT round(sum(train_loss * num_examples) / sum(num_examples), 6) AS train_loss FROM clients"""),
    "robust_round_stats": with_fixtures(["updates", "clients"], """
SELECT CAST(count(*) AS BIGINT) AS clients, CAST(sum(malicious) AS BIGINT) AS malicious_in_round,
       CAST(count(*) * (SELECT count(DISTINCT pos) FROM updates) * 8 AS BIGINT) AS bytes_up,
       CAST(count(*) * (SELECT count(DISTINCT pos) FROM updates) * 8 AS BIGINT) AS bytes_down,
       CAST(count(*) FILTER (WHERE client_id IN (SELECT client_id FROM sel, nn WHERE r <= greatest(1, least(n - f, n)))) AS BIGINT) AS kept_clients,
       CAST(sum(malicious) FILTER (WHERE client_id IN (SELECT client_id FROM sel, nn WHERE r <= greatest(1, least(n - f, n)))) AS BIGINT) AS malicious_kept
FROM clients""", _KRUM_CTES),
    "attack_model_poison": with_fixtures(["updates", "global_params", "clients"], """
SELECT u.client_id, u.pos,
       round(CASE WHEN c.malicious = 1 THEN g.value - 3.0e0 * (u.value - g.value) ELSE u.value END, 6) AS value
FROM updates u JOIN global_params g USING (pos) JOIN clients c USING (client_id)"""),
    "attack_malicious_flags": with_fixtures("clients", """
SELECT client_id, CAST(client_id < round_even(0.3e0 * count(*) OVER (), 0) AS INTEGER) AS malicious FROM clients"""),
    "attack_label_flip": """
SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label_id,
       CAST(CASE WHEN label < 2 THEN 9 - label ELSE label END AS INTEGER) AS train_label FROM embeddings""",
    "params_flatten": with_fixtures("updates", """
SELECT CAST(client_id * 64 + pos AS INTEGER) AS pos, round(value, 6) AS value FROM updates
UNION ALL
SELECT CAST(640 + client_id AS INTEGER) AS pos, round(avg(value), 6) AS value FROM updates GROUP BY client_id"""),
    "robust_attack_study": with_fixtures(["updates", "clients", "global_params"], """
SELECT aggregation, malicious_fraction, round(sqrt(sum((a.value - g.value) * (a.value - g.value))), 6) AS err
FROM (
  SELECT 'fedavg' AS aggregation, u.malicious_fraction, u.pos, sum(c.num_examples * u.value) / sum(c.num_examples) AS value
  FROM pu u JOIN clients c USING (client_id) GROUP BY 2, 3
  UNION ALL
  SELECT 'median', malicious_fraction, pos, median(value) FROM pu GROUP BY 2, 3
  UNION ALL
  SELECT 'trimmed_mean', malicious_fraction, pos, avg(value) FROM (
    SELECT *, row_number() OVER (PARTITION BY malicious_fraction, pos ORDER BY value, client_id) AS rn FROM pu) t
  WHERE rn > greatest(0, least(CAST(floor(f_def / n * n + 1e-9) AS INTEGER), (n - 1) // 2))
    AND rn <= n - greatest(0, least(CAST(floor(f_def / n * n + 1e-9) AS INTEGER), (n - 1) // 2))
  GROUP BY 2, 3
  UNION ALL
  SELECT 'krum', p.malicious_fraction, p.pos, avg(p.value) FROM pu p JOIN ks USING (malicious_fraction, client_id)
  WHERE ks.r <= 1 GROUP BY 2, 3
  UNION ALL
  SELECT 'multikrum', p.malicious_fraction, p.pos, avg(p.value) FROM pu p JOIN ks USING (malicious_fraction, client_id)
  WHERE ks.r <= greatest(1, least(ks.n - ks.fc, ks.n)) GROUP BY 2, 3
) a JOIN global_params g USING (pos)
GROUP BY aggregation, malicious_fraction""", [
        ("cfg", "SELECT * FROM (VALUES (0.0e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) t(malicious_fraction)"),
        ("cm", "SELECT c.client_id, cfg.malicious_fraction, count(*) OVER (PARTITION BY cfg.malicious_fraction) AS n, "
               "CAST(round_even(cfg.malicious_fraction * count(*) OVER (PARTITION BY cfg.malicious_fraction), 0) AS INTEGER) AS f_def "
               "FROM clients c, cfg"),
        ("pu", "SELECT u.client_id, cm.malicious_fraction, u.pos, cm.n, cm.f_def, "
               "CASE WHEN u.client_id < cm.f_def THEN g.value - 3.0e0 * (u.value - g.value) ELSE u.value END AS value "
               "FROM updates u JOIN global_params g USING (pos) JOIN cm USING (client_id)"),
        ("pdd", "SELECT a.malicious_fraction, a.client_id AS c1, b.client_id AS c2, sum((a.value - b.value) * (a.value - b.value)) AS d, "
                "any_value(a.n) AS n, any_value(a.f_def) AS f_def "
                "FROM pu a JOIN pu b ON a.malicious_fraction = b.malicious_fraction AND a.pos = b.pos AND a.client_id <> b.client_id "
                "GROUP BY 1, 2, 3"),
        ("rkk", "SELECT *, greatest(0, least(f_def, (n - 3) // 2)) AS fc, "
                "row_number() OVER (PARTITION BY malicious_fraction, c1 ORDER BY d, c2) AS rr FROM pdd"),
        ("scc", "SELECT malicious_fraction, c1 AS client_id, any_value(n) AS n, any_value(fc) AS fc, sum(d) AS score "
                "FROM rkk WHERE rr <= greatest(1, n - fc - 2) GROUP BY 1, 2"),
        ("ks", "SELECT *, row_number() OVER (PARTITION BY malicious_fraction ORDER BY score, client_id) AS r FROM scc"),
    ]),
}
