"""Registered queries: raw CSVs to the feature store (flow rows with a constant, a copied
feature, incomplete cells and repeated rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.prepare_raw import prepare_from_raw
from rampart.plans.sqlbits import key
from rampart.session import scratch_path
from rampart.sources import tables as T

SEED = 42
FEATS = ["f_value", "f_k", "f_hour", "f_const", "f_copy"]


def _prepared(spark, sf, **kw):
    f, i = T.flows(spark, sf), F.col("row_id")
    value = F.when(i % 40 == 3, F.lit("Infinity")).when(i % 40 == 5, F.lit("bad")).otherwise(F.col("f_value").cast("string"))
    rows = f.select(i.cast("string").alias("Row_ID"), value.alias(" f_value"), F.col("f_k").cast("string").alias("f_k "), F.col("f_hour").cast("string"),
                    F.col("f_const").cast("string"), (F.col("f_k") * 2 + 1).cast("string").alias("f_copy"), F.col("label").alias(" Label"))
    again = rows.where(i % 25 == 1).withColumn("Row_ID", (F.col("Row_ID").cast("bigint") + 10_000_000_000).cast("string"))
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex}")
    rows.unionByName(again).write.option("header", True).csv(path)
    return prepare_from_raw(spark, path, seed=SEED, **kw)


def q_selection(spark, sf):
    m = _prepared(spark, sf).meta
    rows = [(c, fate) for fate, k in (("constant", "dropped_constant"), ("correlated", "dropped_correlated"), ("kept", "feature_names")) for c in m[k]]
    return spark.createDataFrame(rows, "feature string, fate string")


def q_funnel(spark, sf):
    f = _prepared(spark, sf).meta["funnel"]
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(f.items())], "step string, n long")


def q_rows(spark, sf):
    p = _prepared(spark, sf)
    return p.rows.select("split", "row_id", "label_id", *[F.round(F.element_at("features", i + 1), 5).alias(c) for i, c in enumerate(p.features)])


QUERIES = {"prepare_raw_selection": q_selection, "prepare_raw_funnel": q_funnel, "prepare_raw_rows": q_rows}

_RAW = ("raw", """
SELECT row_id, CASE WHEN row_id % 40 = 3 THEN CAST('Infinity' AS DOUBLE) WHEN row_id % 40 = 5 THEN NULL ELSE f_value END AS f_value,
       f_k, f_hour, f_const, f_k * 2 + 1 AS f_copy, label FROM flows
UNION ALL SELECT row_id + 10000000000, CASE WHEN row_id % 40 = 3 THEN CAST('Infinity' AS DOUBLE) WHEN row_id % 40 = 5 THEN NULL ELSE f_value END,
       f_k, f_hour, f_const, f_k * 2 + 1, label FROM flows WHERE row_id % 25 = 1""")
_CLEAN = ("clean", """
SELECT min(row_id) AS row_id, f_value, f_k, f_hour, f_const, f_copy, label FROM raw
WHERE f_value IS NOT NULL AND NOT isinf(f_value) AND f_k IS NOT NULL GROUP BY ALL""")
_SPLIT = ("parts", f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {key('row_id', SEED)}, row_id)
               <= round_even(count(*) OVER (PARTITION BY label) * 0.2e0, 0) THEN 'test' ELSE 'train' END AS split FROM clean""")
_LOG = ("logs", "SELECT split, row_id, label, " + ", ".join(f"sign({c}) * ln(1 + abs({c})) AS {c}" for c in FEATS) + " FROM parts")
_IDS = ("ids", """SELECT label, CAST(CASE WHEN label = 'BENIGN' THEN 0 ELSE row_number() OVER (ORDER BY label <> 'BENIGN', label) - 1 END AS INTEGER)
 AS label_id FROM (SELECT DISTINCT label FROM clean) d""")
_KEPT = ["f_value", "f_k", "f_hour"]

ORACLE = {
    "prepare_raw_selection": with_fixtures("flows", """
SELECT 'f_const' AS feature, CASE WHEN max(f_const) = min(f_const) THEN 'constant' END AS fate FROM parts WHERE split = 'train'
UNION ALL SELECT 'f_copy', CASE WHEN greatest(abs(corr(f_value, f_copy)), abs(corr(f_k, f_copy)), abs(corr(f_hour, f_copy))) > 0.95 THEN 'correlated' ELSE 'kept' END FROM logs WHERE split = 'train'
UNION ALL SELECT 'f_value', 'kept'
UNION ALL SELECT 'f_k', CASE WHEN abs(corr(f_value, f_k)) > 0.95 THEN 'correlated' ELSE 'kept' END FROM logs WHERE split = 'train'
UNION ALL SELECT 'f_hour', CASE WHEN greatest(abs(corr(f_value, f_hour)), abs(corr(f_k, f_hour))) > 0.95 THEN 'correlated' ELSE 'kept' END
FROM logs WHERE split = 'train'""", [_RAW, _CLEAN, _SPLIT, _LOG]),
    "prepare_raw_funnel": with_fixtures("flows", """
SELECT 'rows_raw' AS step, count(*) AS n FROM raw
UNION ALL SELECT 'rows_bad', count(*) FILTER (WHERE f_value IS NULL OR isinf(f_value) OR f_k IS NULL) FROM raw
UNION ALL SELECT 'rows_after_dropna', count(*) FILTER (WHERE f_value IS NOT NULL AND NOT isinf(f_value) AND f_k IS NOT NULL) FROM raw
UNION ALL SELECT 'rows_dedup', count(*) FROM clean""", [_RAW, _CLEAN]),
    "prepare_raw_rows": with_fixtures("flows", "SELECT l.split, l.row_id, i.label_id, " + ", ".join(
        f"round(greatest(-10, least(10, (l.{c} - s.m_{c}) / s.s_{c})), 5) AS {c}" for c in _KEPT)
        + " FROM logs l JOIN ids i ON i.label = l.label, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _KEPT) + " FROM logs WHERE split = 'train') s", [_RAW, _CLEAN, _SPLIT, _LOG, _IDS]),
}
