"""Registered queries: remaining profile/report operators, one-shot averaging and streaming scoring."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from rampart.functions.scalar import is_finite
from rampart.operators import clean as C
from rampart.operators import features as FE
from rampart.plans import centralized as CZ
from rampart.plans import registry_model as RM
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.session import scratch_path
from rampart.sources import io as IO
from rampart.sources import tables as T
from rampart.streaming import scoring as ST

RATE = ["flow_bytes_s", "flow_packets_s"]


def q_replaced(spark, sf):
    _, cnt = C.zero_nonfinite_with_count(T.dirty_flows(spark, sf), RATE)
    return cnt


def q_inspect(spark, sf):
    d = T.dirty_flows(spark, sf)
    return C.inspect_rows(d, F.col("flow_duration") < 0, ["label", "flow_duration"])


def q_inspect_inf(spark, sf):
    d = T.dirty_flows(spark, sf)
    return C.inspect_rows(d, ~is_finite("flow_bytes_s") & F.col("flow_bytes_s").isNotNull(), ["label", "flow_bytes_s"])


def q_top_values(spark, sf):
    return C.top_values(T.dirty_flows(spark, sf), "raw_text", 5)


def q_per_file(spark, sf):
    d = T.dirty_flows(spark, sf).select(F.col("row_id").cast("string"), "label").toDF("Row ID", "Label")
    path = scratch_path(spark, f"perfile-{uuid.uuid4().hex}")
    # (the CSV writer drops outer blanks) a fixed assignment of rows to three day folders, each written by as many tasks as hold its rows
    d.withColumn("day", F.pmod(F.col("Row ID").cast("bigint"), F.lit(3))).write.partitionBy("day").option("header", True).csv(path)
    days = [IO.read_flow_csvs(spark, f"{path}/day={k}").withColumn("source_file", F.lit(f"day{k}")) for k in range(3)]
    return C.per_file_distribution(functools.reduce(lambda a, b: a.unionByName(b), days), "Label")


def q_one_shot(spark, sf):
    from rampart.operators import sampling as S

    tr, va, te, nf, nc = CZ.flow_training_sets(spark, sf)
    part = S.iid_partition(tr, "row_id", 5, 42)
    m = CZ.local_fit_average(part, nf, nc)
    from rampart.plans.federated import evaluate

    met = evaluate(m, te, va)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(met.items())], "metric string, value double")


def q_top_importances(spark, sf):
    imp = FE.forest_importances(T.wide(spark, sf), num_trees=60)
    return FE.top_importances(imp, 6)


def q_most_important(spark, sf):
    imp = FE.forest_importances(T.wide(spark, sf), num_trees=60)
    return FE.most_important(imp, 20).select("rank", "pos", "importance")


def _embedding_stream(spark, sf):
    """The embeddings as a stream, whether the table is one file or a folder of files (a plain
    path, unlike a pattern, may only name a folder)."""
    schema = T.table(spark, sf, "embeddings").schema
    return ST.read_flow_stream(spark, f"{sf.rstrip('/')}/[e]mbeddings.parquet", schema, max_files_per_trigger=1)


def q_stream_score(spark, sf):
    model = RM.class_mean_model(spark, sf)
    stream = _embedding_stream(spark, sf)
    rows = stream.select(F.col("vec_id").alias("row_id"),
                         F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    q = ST.start_detection_sink(ST.scored_stream(rows, model), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("row_id", "prediction", F.round("p_max", 6).alias("p_max"))


def q_stream_confusion(spark, sf):
    """Running (true, predicted) counts of a stream of embedding rows: a stateful streaming
    aggregation whose state is one row per confusion cell."""
    model = RM.class_mean_model(spark, sf)
    stream = _embedding_stream(spark, sf)
    rows = stream.select(F.col("label").cast("int").alias("label_id"),
                         F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    base = scratch_path(spark, f"stream-conf-{uuid.uuid4().hex}")
    q = ST.start_state_sink(ST.running_confusion(rows, model), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("y").cast("int").alias("y"),
                                                     F.col("p").cast("int").alias("p"), "cnt")


QUERIES = {
    "clean_nonfinite_replaced": q_replaced,
    "profile_inspect_negative_duration": q_inspect,
    "profile_inspect_infinite_rate": q_inspect_inf,
    "profile_top_values": q_top_values,
    "profile_per_file": q_per_file,
    "model_one_shot_average": q_one_shot,
    "features_top_importances": q_top_importances,
    "features_most_important": q_most_important,
    "streaming_score": q_stream_score,
    "streaming_confusion": q_stream_confusion,
}

ORACLE = {
    "clean_nonfinite_replaced": with_fixtures("dirty", "SELECT CAST(sum(" + " + ".join(
        f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}) THEN 0 ELSE 1 END" for c in RATE)
        + ") AS BIGINT) AS n_replaced, count(*) AS rows_used FROM dirty"),
    "profile_inspect_negative_duration": with_fixtures("dirty", """
SELECT row_id, label, flow_duration FROM dirty WHERE flow_duration < 0 ORDER BY row_id LIMIT 20"""),
    "profile_inspect_infinite_rate": with_fixtures("dirty", """
SELECT row_id, label, flow_bytes_s FROM dirty WHERE flow_bytes_s IS NOT NULL AND (isnan(flow_bytes_s) OR isinf(flow_bytes_s))
ORDER BY row_id LIMIT 20"""),
    "profile_top_values": with_fixtures("dirty", """
SELECT raw_text, count(*) AS n FROM dirty GROUP BY raw_text ORDER BY n DESC, raw_text ASC NULLS FIRST LIMIT 5"""),
    "profile_per_file": with_fixtures("dirty", """
SELECT 'day' || (row_id % 3) AS source_file, trim(label) AS "Label", count(*) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY row_id % 3) AS BIGINT) AS file_rows
FROM dirty GROUP BY row_id % 3, trim(label)"""),
    "streaming_score": RM.ORACLE["model_score"],
    "streaming_confusion": with_fixtures("updates", """
SELECT CAST(label_id AS INTEGER) AS y, CAST(cls AS INTEGER) AS p, count(*) AS cnt FROM pn WHERE rk = 1
GROUP BY label_id, cls""", RM.SCORE_CTES),
}
