"""Sources and sinks: raw flow CSVs, split tables, the feature store, metadata, run logs, results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = "Label"
ROW_ID = "Row_ID"
SPLIT_FILES = {"train": "train", "val": "validation", "test": "test"}


# ------------------------------------------------------------------ file listing (data source API, any store)
def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, by the data source's own path check (no content is read)."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _list_files(spark: SparkSession, directory: str, glob: str) -> list[str]:
    """Sorted paths of the files matching ``directory/glob`` (listing only: the ``content``
    column of the binary-file source is never selected, so no file body is read)."""
    pattern = f"{directory.rstrip('/')}/{glob}"
    if not _exists(spark, directory):
        return []
    try:
        rows = spark.read.format("binaryFile").load(pattern).select("path").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["path"] for r in rows)


# ------------------------------------------------------------------ raw flow CSVs (S1-S3)
def _first_lines(batches, encoding: str):
    """Executor side: the first line of every file in the batch (``pyarrow`` file systems:
    local, S3, GCS, HDFS), reading at most until the first newline. None when the scheme is
    not readable from Python."""
    import pandas as pd
    import pyarrow.fs as pafs

    for pdf in batches:
        out = []
        for path in pdf["path"]:
            try:
                fs, inner = pafs.FileSystem.from_uri(path)
                buf = b""
                with fs.open_input_stream(inner) as fh:
                    while b"\n" not in buf:
                        chunk = fh.read(1 << 16)
                        if not chunk:
                            break
                        buf += chunk
                out.append(buf.split(b"\n", 1)[0].rstrip(b"\r").decode(encoding))
            except Exception:  # noqa: BLE001 - e.g. a scheme pyarrow cannot open: the driver falls back
                out.append(None)
        yield pd.DataFrame({"path": pdf["path"], "header": out})


def header_columns_many(spark: SparkSession, paths: Sequence[str], encoding: str = "ISO-8859-1") -> dict[str, list[str]]:
    """Raw header names of many CSV files in ONE distributed job: the executors read only each
    file's first line (no header handling, so names keep their spaces and duplicates are not
    renamed). Files whose store Python cannot open are peeked with a one-line Spark read."""
    import csv

    if not paths:
        return {}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    n = max(1, min(len(paths), spark.sparkContext.defaultParallelism))
    rows = df.repartition(n).mapInPandas(lambda it: _first_lines(it, encoding), "path string, header string").collect()
    out = {r["path"]: (next(csv.reader([r["header"]])) if r["header"] else []) for r in rows if r["header"] is not None}
    for p in paths:
        if p not in out:
            out[p] = header_columns(spark, p, encoding)
    return out


def header_columns(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> list[str]:
    """Raw header names of one CSV file: its first line read as a data row. Only the first
    line of the first split is parsed."""
    row = (spark.read.option("header", False).option("encoding", encoding).option("inferSchema", False)
           .csv(path).limit(1).collect())
    return [] if not row else ["" if v is None else v for v in row[0]]


def normalised_names(raw: Sequence[str]) -> tuple[list[str], list[int]]:
    """Strip names; keep the first of duplicate names and drop pandas-style ``name.1`` copies.

    Returns (kept names, their positions in the file).
    """
    names = [c.strip() for c in raw]
    keep, seen = [], set()
    for i, n in enumerate(names):
        base, dot, suffix = n.rpartition(".")
        mangled = dot and suffix.isdigit() and base in names[:i]
        if n in seen or mangled:
            continue
        seen.add(n)
        keep.append(i)
    return [names[i] for i in keep], keep


def _read_with_header(spark: SparkSession, paths: list[str], raw: list[str], encoding: str) -> DataFrame:
    names, pos = normalised_names(raw)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(raw))])
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
          .option("encoding", encoding).option("mode", "PERMISSIVE").csv(paths))
    return df.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(pos, names)],
                     F.col("_metadata.file_name").alias("source_file"))


def read_flow_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One CSV file, every cell as text, header normalised; adds ``source_file``."""
    return _read_with_header(spark, [path], header_columns(spark, path, encoding), encoding)


def read_flow_csvs(spark: SparkSession, directory: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Every ``*.csv`` in ``directory``, each column matched by its own file's header, unioned by name.

    A multi-file CSV read aligns columns by position, so files are grouped by identical
    raw header and each group is one parallel read; groups are unioned by name (missing
    columns become NULL). The headers of all files are peeked in one distributed job, so
    thousands of day files with a handful of layouts cost one small job plus a handful of
    scans.
    """
    files = _list_files(spark, directory, "*.csv")
    if not files:
        raise FileNotFoundError(f"no CSV files in {directory}")
    headers = header_columns_many(spark, files, encoding)
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        groups.setdefault(tuple(headers[f]), []).append(f)
    out = None
    for raw, paths in groups.items():
        d = _read_with_header(spark, paths, list(raw), encoding)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ split tables (S4)
def read_split(spark: SparkSession, directory: str, split: str, suffix: str = "_group_aware") -> DataFrame:
    """``<train|validation|test><suffix>.csv`` with a required ``Label`` column; adds ``split``."""
    path = f"{directory.rstrip('/')}/{SPLIT_FILES.get(split, split)}{suffix}.csv"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = read_flow_csv(spark, path).drop("source_file")
    if LABEL not in df.columns:
        raise KeyError(f"{path} has no '{LABEL}' column")
    return df.withColumn("split", F.lit(split))


def read_splits(spark: SparkSession, directory: str, suffix: str = "_group_aware") -> DataFrame:
    frames = [read_split(spark, directory, s, suffix) for s in SPLIT_FILES]
    cols = [c for c in frames[0].columns if c != "split"]
    for f in frames[1:]:
        other = [c for c in f.columns if c != "split"]
        if other != cols:
            raise ValueError("feature columns differ between splits")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------------ feature store (S6-S8)
def write_feature_store(df: DataFrame, out: str, features: str = "features", mode: str = "overwrite") -> None:
    """Rows (split, row_id, label_id, features) partitioned by split; features narrowed to float."""
    df.withColumn(features, F.transform(features, lambda x: x.cast("float"))) \
        .write.mode(mode).partitionBy("split").parquet(out)


def read_feature_store(spark: SparkSession, out: str, split: str | None = None, features: str = "features") -> DataFrame:
    """Read back (partition pruning on ``split``), features widened to double for maths."""
    df = spark.read.parquet(out)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.withColumn(features, F.transform(features, lambda x: x.cast("double")))


def write_meta(spark: SparkSession, out: str, meta: dict) -> None:
    """Metadata document as one JSON row (names, stats, class map, counts)."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(out)


def read_meta(spark: SparkSession, out: str) -> dict:
    if not _exists(spark, out):
        raise FileNotFoundError(f"{out} not found: write the feature store first")
    rows = spark.read.text(out).collect()
    return json.loads(rows[0][0])


def class_counts_table(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ run logs (S9-S10)
def append_round_log(df: DataFrame, directory: str) -> None:
    """Append-only round log, one folder per run (never rewritten per round)."""
    df.write.mode("append").partitionBy("run_name").parquet(directory)


def write_run_log(df: DataFrame, directory: str) -> None:
    """A finished run's whole log, replacing only that run's folder (dynamic partition overwrite):
    re-running a run never duplicates its rows, other runs' logs are untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(directory)


def scan_round_logs(spark: SparkSession, directory: str, schema: T.StructType | None = None,
                    min_rows: int = 2) -> DataFrame:
    """All runs' logs; runs with fewer than ``min_rows`` rows are skipped."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(directory)
    n = F.count(F.lit(1)).over(Window.partitionBy("run_name"))
    return df.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


# ------------------------------------------------------------------ results (S11-S12)
LEGACY_SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("Model", T.StringType()), ("Test Accuracy", T.DoubleType()), ("Test Balanced Accuracy", T.DoubleType()),
    ("Test Macro F1", T.DoubleType()), ("Test Weighted F1", T.DoubleType()))])


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType = LEGACY_SCHEMA) -> DataFrame:
    """A results CSV with a fixed schema; a missing file gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV files; ``single_file`` gathers report tables (a few rows per run) in one."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)
