"""Registered queries: source/sink round trips on data derived from the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rampart.operators import clean as C
from rampart.plans import registry_features as RF
from rampart.plans.centralized import flow_training_sets
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import FLOWS_ENC, LABEL_MAP
from rampart.session import scratch_path
from rampart.sources import io as IO
from rampart.sources import tables as T

# raw header of the written day files: padded names, a name that collides after
# stripping, and a pandas-style mangled copy (both later copies must be dropped)
RAW_HEADER = [" Row ID", " Label", " Flow Bytes/s", "Flow Packets/s ", " Flow Duration", "Flow Duration",
              "Flow Duration.1", "raw_text"]


def q_flow_csv(spark, sf):
    d = T.dirty_flows(spark, sf)
    lab = F.when(F.col("row_id") % 13 == 0, F.concat(F.col("label"), F.lit(" éé x"))).otherwise(F.col("label"))
    out = d.select(F.col("row_id").cast("string"), lab, F.col("flow_bytes_s").cast("string"),
                   F.col("flow_packets_s").cast("string"), F.col("flow_duration").cast("string"),
                   F.lit("-999").alias("dup1"), F.lit("-998").alias("dup2"), "raw_text").toDF(*RAW_HEADER)
    path = scratch_path(spark, f"flowcsv-{uuid.uuid4().hex}")
    out.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = IO.read_flow_csvs(spark, path)
    back = C.clean_labels(back, "Label")
    back = C.coerce_numeric(back, ["Flow Bytes/s", "Flow Packets/s", "Flow Duration"])
    return back.select(F.col("Row ID").cast("bigint").alias("row_id"), F.col("Label").alias("label"),
                       F.round("Flow Bytes/s", 6).alias("flow_bytes_s"),
                       F.round("Flow Packets/s", 6).alias("flow_packets_s"),
                       F.round("Flow Duration", 6).alias("flow_duration"))


def q_feature_store(spark, sf):
    tr, va, te, nf, nc = flow_training_sets(spark, sf)
    rows = tr.withColumn("split", F.lit("train")).unionByName(va.withColumn("split", F.lit("val"))) \
        .unionByName(te.withColumn("split", F.lit("test")))
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    IO.write_feature_store(rows, path)
    back = IO.read_feature_store(spark, path, "test")
    return back.select("row_id", "label_id", *[F.round(F.element_at("features", i + 1), 6).alias(f"x{i}")
                                                for i in range(nf)])


def q_round_log(spark, sf):
    path = scratch_path(spark, f"rounds-{uuid.uuid4().hex}")
    IO.append_round_log(T.round_logs(spark, sf), path)
    back = IO.scan_round_logs(spark, path)
    return back.select("run_name", "round", F.round("f1", 6).alias("f1"), "clients")


QUERIES = {
    "sources_flow_csv_roundtrip": q_flow_csv,
    "sources_feature_store_roundtrip": q_feature_store,
    "sources_round_log_roundtrip": q_round_log,
}

ORACLE = {
    "sources_flow_csv_roundtrip": with_fixtures("dirty", r"""
SELECT row_id,
       trim(regexp_replace(CASE WHEN row_id % 13 = 0 THEN label || ' éé x' ELSE label END, '[^\x00-\x7F]+', '-', 'g'))
         AS label,
       round(flow_bytes_s, 6) AS flow_bytes_s, round(flow_packets_s, 6) AS flow_packets_s,
       round(flow_duration, 6) AS flow_duration
FROM dirty"""),
    "sources_feature_store_roundtrip": with_fixtures("flows", "SELECT row_id, label_id, " + ", ".join(
        f"round(CAST(CAST(greatest(-10.0e0, least(10.0e0, ({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0e0 ELSE s_{c} END))"
        f" AS FLOAT) AS DOUBLE), 6) AS x{i}" for i, c in enumerate(RF.FEATS)) + " FROM tt, st WHERE split = 'test'",
        [LABEL_MAP, FLOWS_ENC, (RF._SPLIT[0], RF._SPLIT[1].replace("FROM flows", "FROM fl")),
         ("tt", "SELECT row_id, label_id, split, " + ", ".join(f"{RF._slog(c)} AS {c}" for c in RF.FEATS) + " FROM sfl"),
         ("st", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in RF.FEATS)
          + " FROM tt WHERE split = 'train'")]),
    "sources_round_log_roundtrip": with_fixtures("rounds", "SELECT run_name, round, round(f1, 6) AS f1, clients FROM rounds"),
}
