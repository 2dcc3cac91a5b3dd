"""Structured Streaming: score arriving flow rows with a fixed model and append detections.

Scoring and metric logging are stateless per row, so they run unchanged on
``readStream``; each micro-batch is appended to a Parquet sink (exactly-once through the
checkpoint location). The running confusion table is a streaming aggregation whose
state is bounded by (classes x classes) keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rampart.operators.model import LinearModel, score


def read_flow_stream(spark: SparkSession, source_dir: str, schema: StructType,
                     max_files_per_trigger: int | None = None, file_glob: str | None = None) -> DataFrame:
    """Parquet files arriving in ``source_dir`` (optionally only names matching ``file_glob``)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def scored_stream(stream: DataFrame, model: LinearModel, features: str = "features",
                  keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Adds prediction, class probabilities and the attack flag to every arriving row."""
    sc = score(stream, model, features)
    return sc.select(*keep, "prediction", "p_max", (F.col("prediction") != 0).cast("int").alias("is_attack"))


def start_detection_sink(scored: DataFrame, out_dir: str, checkpoint_dir: str,
                         available_now: bool = True) -> StreamingQuery:
    """Append detections to Parquet; ``available_now`` processes what exists and stops."""
    w = scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_confusion(stream: DataFrame, model: LinearModel, label: str = "label_id",
                      features: str = "features") -> DataFrame:
    """Streaming confusion counts (complete mode); state = one row per (true, predicted) pair."""
    sc = score(stream, model, features)
    return sc.groupBy(F.col(label).alias("y"), F.col("prediction").alias("p")).agg(F.count(F.lit(1)).alias("cnt"))


def start_state_sink(agg: DataFrame, out_dir: str, checkpoint_dir: str,
                     available_now: bool = True) -> StreamingQuery:
    """Complete-mode sink for a bounded streaming aggregation (e.g. ``running_confusion``).

    Every micro-batch carries the whole current result (at most classes x classes rows);
    it overwrites ``out_dir``, so a replayed batch after a failure writes the same table
    again (idempotent), and the state itself lives in the checkpoint location.
    """
    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
