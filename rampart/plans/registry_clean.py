"""Registered queries: cleaning and profiling (F-dirty, F-flows fixtures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import clean as C
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.sources import tables as T

RATE_COLS = ["flow_bytes_s", "flow_packets_s"]
NUM_COLS = ["flow_bytes_s", "flow_packets_s", "flow_duration"]
SUMMARY_COLS = ["f_value", "f_k", "f_hour"]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q_label_repair(spark, sf):
    return C.clean_labels(T.dirty_flows(spark, sf)).select("row_id", "label")


def q_coerce(spark, sf):
    d = T.dirty_flows(spark, sf)
    d = C.coerce_numeric(d, ["raw_text"])
    d = C.strict_clean(d, ["flow_bytes_s"])
    d = C.lenient_clean(d, ["flow_packets_s"])
    d = C.repair_negative(d, ["flow_duration"])
    return d.select("row_id", F.col("raw_text").alias("raw_num"), r6("flow_bytes_s").alias("flow_bytes_s"),
                    r6("flow_packets_s").alias("flow_packets_s"), r6("flow_duration").alias("flow_duration"))


def q_drop_incomplete(spark, sf):
    d = C.strict_clean(T.dirty_flows(spark, sf), RATE_COLS)
    return C.drop_incomplete(d, RATE_COLS).select("row_id")


def q_funnel(spark, sf):
    return C.cleaning_funnel(T.dirty_flows(spark, sf), RATE_COLS, ["label", "raw_text"])


def q_funnel_used(spark, sf):
    """With the rows that a tenth of every label (20 at least) takes."""
    return C.cleaning_funnel(T.dirty_flows(spark, sf), RATE_COLS, ["label", "raw_text"], "label", 0.1)


def q_defects(spark, sf):
    """Missing, infinite and negative cells before and after cleaning, from one scan."""
    return C.defect_totals(T.dirty_flows(spark, sf), NUM_COLS, lambda d: C.repair_negative(C.lenient_clean(d, NUM_COLS), NUM_COLS))


def q_inspect_null_rate(spark, sf):
    d = T.dirty_flows(spark, sf)
    return C.inspect_rows(d, F.col("flow_bytes_s").isNull(), ["label", "flow_bytes_s"])


def q_inspect_zero_duration(spark, sf):
    d = T.dirty_flows(spark, sf)
    return C.inspect_rows(d, F.col("flow_duration") == 0, ["label", "flow_duration", *RATE_COLS])


def q_missing(spark, sf):
    return C.missing_infinite_counts(T.dirty_flows(spark, sf), NUM_COLS)


def q_summary(spark, sf):
    s = C.numeric_summary(T.flows(spark, sf), SUMMARY_COLS)
    return s.select("column", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


def q_summary_dirty(spark, sf):
    """NaN and NULL cells are missing values; infinities stay."""
    s = C.numeric_summary(T.dirty_flows(spark, sf), NUM_COLS)
    return s.select("column", "count", r6("min").alias("min"), r6("max").alias("max"))


def q_quantiles_dirty(spark, sf):
    """A column with NaN and NULL cells, and one without any value."""
    d = T.dirty_flows(spark, sf).withColumn("nothing", F.lit(None).cast("double"))
    q = C.exact_quantiles(d, ["flow_duration", "nothing"])
    return q.select("column", "prob", r6("value").alias("value"))


def q_quantiles(spark, sf):
    q = C.exact_quantiles(T.flows(spark, sf), SUMMARY_COLS)
    return q.select("column", "prob", r6("value").alias("value"))


def q_label_dist(spark, sf):
    return C.label_distribution(T.flows(spark, sf)).select("label", "n", r6("pct").alias("pct"))


def q_zero_duration(spark, sf):
    z = C.zero_duration_profile(T.dirty_flows(spark, sf), "flow_duration", RATE_COLS)
    return z.select("label", "n_zero", *[r6(c).alias(c) for c in z.columns if c.endswith("_rate")])


def q_duplicates(spark, sf):
    return C.duplicate_count(T.dirty_flows(spark, sf), ["label", "raw_text"])


def q_dedup(spark, sf):
    return T.dirty_flows(spark, sf).select("label", "raw_text").dropDuplicates()


QUERIES = {
    "clean_label_repair": q_label_repair,
    "clean_numeric_coerce": q_coerce,
    "clean_drop_incomplete": q_drop_incomplete,
    "clean_funnel": q_funnel,
    "clean_funnel_used": q_funnel_used,
    "profile_defect_totals": q_defects,
    "profile_inspect_null_rate": q_inspect_null_rate,
    "profile_inspect_zero_duration": q_inspect_zero_duration,
    "profile_missing_inf": q_missing,
    "profile_numeric_summary": q_summary,
    "profile_quantiles": q_quantiles,
    "profile_numeric_summary_dirty": q_summary_dirty,
    "profile_quantiles_dirty": q_quantiles_dirty,
    "profile_label_distribution": q_label_dist,
    "profile_zero_duration": q_zero_duration,
    "profile_duplicates": q_duplicates,
    "clean_dedup": q_dedup,
}

_FIN = "({x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}))"


def _fin(x):
    return _FIN.format(x=x)


_KEPT = f"SELECT * FROM dirty WHERE {_fin('flow_bytes_s')} AND {_fin('flow_packets_s')}"
_CELLS = {"n_missing": "({c} IS NULL OR isnan({c}))", "n_infinite": "isinf({c})", "n_negative": "{c} < 0"}

ORACLE = {
    "clean_funnel_used": with_fixtures("dirty", f"""
SELECT (SELECT count(*) FROM dirty) AS rows_raw, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM ({_KEPT}) k) AS rows_bad,
       (SELECT count(*) FROM ({_KEPT}) k) AS rows_after_dropna, CAST(sum(n) AS BIGINT) AS rows_dedup,
       CAST(sum(least(n, greatest(round_even(n * 0.1e0, 0), 20))) AS BIGINT) AS rows_used
FROM (SELECT label, count(*) AS n FROM (SELECT DISTINCT label, raw_text FROM ({_KEPT}) k) d GROUP BY label) p"""),
    "profile_defect_totals": with_fixtures("dirty", "SELECT 'before' AS stage, count(*) AS n_rows, " + ", ".join(
        "CAST(" + " + ".join(f"count(*) FILTER (WHERE {t.format(c=c)})" for c in NUM_COLS) + f" AS BIGINT) AS {k}" for k, t in _CELLS.items())
        + " FROM dirty UNION ALL SELECT 'after', count(*), 0, 0, 0 FROM dirty"),
    "profile_inspect_null_rate": with_fixtures("dirty", """
SELECT row_id, label, flow_bytes_s FROM dirty WHERE flow_bytes_s IS NULL ORDER BY row_id LIMIT 20"""),
    "profile_inspect_zero_duration": with_fixtures("dirty", """
SELECT row_id, label, flow_duration, flow_bytes_s, flow_packets_s FROM dirty WHERE flow_duration = 0 ORDER BY row_id LIMIT 20"""),
    "clean_label_repair": with_fixtures("dirty", r"""
SELECT row_id, trim(regexp_replace(label, '[^\x00-\x7F]+', '-', 'g')) AS label FROM dirty"""),
    "clean_numeric_coerce": with_fixtures("dirty", f"""
SELECT row_id, TRY_CAST(raw_text AS DOUBLE) AS raw_num,
       round(CASE WHEN {_fin('flow_bytes_s')} THEN flow_bytes_s END, 6) AS flow_bytes_s,
       round(CASE WHEN {_fin('flow_packets_s')} THEN flow_packets_s ELSE 0.0e0 END, 6) AS flow_packets_s,
       round(CASE WHEN flow_duration < 0 THEN 0.0e0 ELSE flow_duration END, 6) AS flow_duration
FROM dirty"""),
    "clean_drop_incomplete": with_fixtures("dirty", f"""
SELECT row_id FROM dirty WHERE {_fin('flow_bytes_s')} AND {_fin('flow_packets_s')}"""),
    "clean_funnel": with_fixtures("dirty", f"""
SELECT count(*) AS rows_raw,
       count(*) FILTER (WHERE NOT ({_fin('flow_bytes_s')} AND {_fin('flow_packets_s')})) AS rows_bad,
       count(*) FILTER (WHERE {_fin('flow_bytes_s')} AND {_fin('flow_packets_s')}) AS rows_after_dropna,
       (SELECT count(*) FROM (SELECT DISTINCT label, raw_text FROM dirty
                              WHERE {_fin('flow_bytes_s')} AND {_fin('flow_packets_s')}) d) AS rows_dedup
FROM dirty"""),
    "profile_missing_inf": with_fixtures("dirty", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_missing, "
        f"count(*) FILTER (WHERE isinf({c})) AS n_inf FROM dirty" for c in NUM_COLS) +
        ") t WHERE n_missing > 0 OR n_inf > 0"),
    "profile_numeric_summary": with_fixtures("flows", " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM flows" for c in SUMMARY_COLS)),
    "profile_numeric_summary_dirty": with_fixtures("dirty", " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(x) AS count, round(min(x), 6) AS min, round(max(x), 6) AS max "
        f"FROM (SELECT CASE WHEN NOT isnan({c}) THEN {c} END AS x FROM dirty) t" for c in NUM_COLS)),
    "profile_quantiles_dirty": with_fixtures("dirty", " UNION ALL ".join(
        f"SELECT 'flow_duration' AS column, {p}e0 AS prob, round(quantile_cont(x, {p}), 6) AS value "
        "FROM (SELECT CASE WHEN NOT isnan(flow_duration) THEN flow_duration END AS x FROM dirty) t "
        f"UNION ALL SELECT 'nothing', {p}e0, CAST(NULL AS DOUBLE)" for p in ("0.25", "0.5", "0.75"))),
    "profile_quantiles": with_fixtures("flows", " UNION ALL ".join(
        f"SELECT '{c}' AS column, {p}e0 AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM flows"
        for c in SUMMARY_COLS for p in ("0.25", "0.5", "0.75"))),
    "profile_label_distribution": with_fixtures("flows", """
SELECT label, count(*) AS n, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct FROM flows GROUP BY label"""),
    "profile_zero_duration": with_fixtures("dirty", """
SELECT label, count(*) AS n_zero,
""" + ",\n".join(
        f"round(avg(CAST(({c} IS NULL OR isnan({c})) AS DOUBLE)), 6) AS {c}_null_rate, "
        f"round(avg(CAST(coalesce(isinf({c}), false) AS DOUBLE)), 6) AS {c}_inf_rate" for c in RATE_COLS) + """
FROM dirty WHERE flow_duration = 0 GROUP BY label"""),
    "profile_duplicates": with_fixtures("dirty", """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT label, raw_text FROM dirty) d) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT label, raw_text FROM dirty) d) AS n_duplicates
FROM dirty"""),
    "clean_dedup": with_fixtures("dirty", "SELECT DISTINCT label, raw_text FROM dirty"),
}
