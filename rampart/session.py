"""Session helpers: a tuned local session for tests, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rampart") -> SparkSession:
    """Session for tests and local benchmarks (UI off, AQE on, UTC, ANSI left at its default)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RAMPART_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster the folder must come from ``spark.checkpoint.dir`` (shared storage).
    Only a local-mode session without that setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on a cluster")
        path = tempfile.mkdtemp(prefix="rampart-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)  # goes with the process that made it
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the application's own part of the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rampart-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written. Results that still read
    one become unreadable, so call it when they have been consumed or written elsewhere."""
    _delete(spark, _scratch_root(spark))


#: folders written by ``materialize`` inside an open ``scratch_scope``
_SCOPES: list[list[str]] = []


def materialize(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (iterative jobs rescan compact columnar files, not the whole upstream
    plan) and, unlike a cache, survives the loss of executors.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    for scope in _SCOPES:
        scope.append(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def discard(*tables) -> None:
    """Delete tables made by ``materialize`` that nothing will read again (their successor has
    been written), so a long job holds a few of them at a time."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are deleted at its end, so write what
    must stay with ``keep``: ``with scratch_scope(spark) as keep: out = keep(df, name)``. Shuffle
    files of the block's frames go too, as soon as the driver has collected them."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df, name: str):
        out = materialize(df, name)
        kept.add(out._scratch_path)
        return out

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in made:
            if path not in kept:
                _delete(spark, path)
        spark.sparkContext._jvm.System.gc()  # Spark removes the shuffles of frames that are gone


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rampart`` importable in the Python workers (Arrow partials, pickled operators).

    The package is zipped once per application and added with ``SparkContext.addPyFile``
    (the programmatic ``--py-files``). The zip goes into the checkpoint folder when that is a
    local path (local mode); with a shared store, ship the package at submit time instead.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    elif "://" in base:
        _SHIPPED.add(app)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(base, f"rampart-{app}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
