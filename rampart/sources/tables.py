"""Readers for the input tables and the fixture views derived from them.

The fixtures turn the generic test tables into the shapes this engine works on
(flow rows, dirty flow rows, wide feature rows, split tables, predictions, client
updates, round logs). Each is a plain projection/aggregation, so its work grows
with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.functions.attach import with_scalars
from rampart.functions.scalar import BENIGN

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values for the fixtures.
N_ORGS = 5           # silo count of the flow fixture
FLOW_FEATURES = ["f_value", "f_k", "f_hour", "f_const"]
N_WIDE = 64          # embedding width
UPDATE_FRACTION = 0.2
POISON_SCALE = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-flows: one row per event, text label, organisation, four numeric features."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "view", F.lit(BENIGN)).otherwise(F.upper("event_type")).alias("label"),
        (F.col("user_id") % N_ORGS).alias("org"),
        F.col("value").alias("f_value"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("f_k"),
        F.hour("ts").cast("double").alias("f_hour"),
        F.lit(7.0).cast("double").alias("f_const"),
    )


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-dirty: flow rows with planted padding, inf/NaN/NULL cells, negative durations, bad text."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    v = F.col("value")
    return ev.select(
        i.alias("row_id"),
        F.when(i % 11 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.col("event_type")).alias("label"),
        F.when(i % 97 == 0, F.lit(float("inf")))
        .when(i % 89 == 0, F.lit(float("nan")))
        .when(i % 83 == 0, F.lit(None).cast("double"))
        .otherwise(v)
        .alias("flow_bytes_s"),
        F.when(i % 79 == 0, F.lit(float("-inf"))).otherwise(v * 2).alias("flow_packets_s"),
        F.when(i % 73 == 0, F.lit(-1.0)).when(i % 71 == 0, F.lit(0.0)).otherwise(v).alias("flow_duration"),
        F.when(i % 61 == 0, F.lit("bad")).otherwise((i % 50).cast("int").cast("string")).alias("raw_text"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-wide: one row per vector, 64 double features as an array, class label (0 = benign)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("int").alias("label_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-wide unnested: (row_id, label_id, pos, value)."""
    return wide(spark, sf_dir).select("row_id", "label_id", F.posexplode("features").alias("pos", "value"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-splits: documents as split tables (plain id-based split that leaks text copies)."""
    doc = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    return doc.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("feats"),
        F.col("lang").alias("label"),
        F.when(m < 6, "train").when(m < 8, "val").otherwise("test").alias("split"),
    )


def binary_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-preds binary: quality as truth, toxic as prediction."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


def _vector_means(df: DataFrame, keys: list) -> DataFrame:
    """Per-group coordinate means of the feature arrays (vector sums, no per-coordinate rows)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    m = df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("features"))).alias("_m"))
    return m.select(*keys, F.posexplode("_m").alias("pos", "value"))


def client_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-updates: one client per embedding label; value = per-client mean of each coordinate."""
    return _vector_means(wide(spark, sf_dir).withColumnRenamed("label_id", "client_id"), ["client_id"])


def client_info(spark: SparkSession, sf_dir: str, fraction: float = UPDATE_FRACTION) -> DataFrame:
    """Per client: example count, a train loss stand-in and the malicious flag."""
    w = wide(spark, sf_dir)
    clients = w.groupBy(F.col("label_id").alias("client_id")).agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.avg(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.lit(float(N_WIDE))).alias(
            "train_loss"
        ),
    )
    n = clients.agg(F.count(F.lit(1)).alias("n"))
    return with_scalars(clients, n).select(
        "client_id",
        "num_examples",
        "train_loss",
        (F.col("client_id") < F.bround(F.lit(float(fraction)) * F.col("n"), 0)).cast("int").alias("malicious"),
    )


def client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-updates in ONE pass over the embeddings: per client (label) the coordinate sums, the row
    count and the train-loss stand-in. Updates, client info and the global parameters all derive
    from these few rows (global mean = sum of client sums / sum of counts)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = wide(spark, sf_dir)
    return w.groupBy(F.col("label_id").alias("client_id")).agg(
        vector_to_array(Summarizer.sum(array_to_vector("features"))).alias("sums"),
        F.count(F.lit(1)).alias("num_examples"),
        F.avg(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.lit(float(N_WIDE))).alias(
            "train_loss"),
    )


def updates_of(stats: DataFrame) -> DataFrame:
    """``(client_id, pos, value)``: per-client coordinate means from ``client_stats``."""
    means = F.transform("sums", lambda v: v / F.col("num_examples"))
    return stats.select("client_id", F.posexplode(means).alias("pos", "value"))


def client_info_of(stats: DataFrame) -> DataFrame:
    """``(client_id, num_examples, train_loss)`` from ``client_stats``."""
    return stats.select("client_id", "num_examples", "train_loss")


def global_params_of(stats: DataFrame) -> DataFrame:
    """``(pos, value)``: coordinate means over all rows = sum of client sums / sum of counts."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    tot = stats.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("_s"),
                    F.sum("num_examples").alias("_n"))
    return tot.select(F.posexplode(F.transform("_s", lambda v: v / F.col("_n"))).alias("pos", "value"))


def global_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global parameter vector: mean over all rows per coordinate."""
    return _vector_means(wide(spark, sf_dir), [])


def round_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-rounds: per-round run logs built from events (8 runs x 30 rounds)."""
    ev = table(spark, sf_dir, "events")
    u8 = F.col("user_id") % 8
    u4 = (F.col("user_id") % 4).cast("int")
    d = F.dayofmonth("ts")
    g = ev.groupBy(u8.alias("u8"), u4.alias("u4"), d.alias("d")).agg(
        F.avg("value").alias("av"),
        F.max("value").alias("mx"),
        F.min("value").alias("mn"),
        F.sum("value").alias("sm"),
        F.count(F.lit(1)).alias("cnt"),
        F.max("ts").alias("last_ts"),
    )
    return g.select(
        F.concat(F.lit("run_"), F.col("u8").cast("string")).alias("run_name"),
        F.when(F.col("u4") == 0, "fedavg").when(F.col("u4") == 1, "median").when(F.col("u4") == 2, "krum")
        .otherwise("multikrum").alias("aggregation"),
        F.when(F.col("u8") < 4, "none").otherwise("label_flip").alias("attack"),
        F.when(F.col("u8") < 4, F.lit(0.0)).otherwise(F.lit(0.2)).alias("malicious_fraction"),
        (F.col("d") - 1).cast("int").alias("round"),
        F.when(F.col("d") == 1, F.lit(None).cast("int")).otherwise(F.lit(10)).alias("clients"),
        (F.col("av") / 500).alias("f1"),
        (F.col("mx") / 500).alias("recall"),
        (F.col("mn") / 500).alias("fpr"),
        (F.col("av") / 400).alias("val_macro_f1"),
        (F.col("sm") / 1000).alias("agg_time_s"),
        (F.col("cnt") * 512).cast("bigint").alias("bytes_up"),
        F.when(F.col("d") == 1, F.lit(None).cast("int")).when(F.col("u8") < 4, F.lit(0)).otherwise(F.lit(2))
        .alias("malicious_in_round"),
        F.when((F.col("d") > 1) & (F.col("u4") >= 2), (F.col("cnt") % 3).cast("int")).alias("malicious_kept"),
        F.col("last_ts").alias("logged_at"),
    )
