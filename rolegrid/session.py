"""Session defaults and the shared folder for durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are designed around; every one is a stock Spark knob.
# The hot-key strategy for "many rows -> one row per key" joins is AQE's skew
# split, also where it costs an extra exchange.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "rolegrid", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**CLUSTER_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    without that setting gets a temporary folder of its own; anywhere else a
    missing setting is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is not None:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rolegrid-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: a table written in the shared folder survives executor loss.

    Unlike an eager checkpoint, which computes its rows once to run and once
    more to write, this is one job.
    """
    return stage(df, "cut")


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where later steps filter on derived text columns: reading stored
    columns keeps those filters in the scan instead of re-running the text
    expressions inside every filter. The shuffle files behind the written rows
    go with the write; nothing reads them again. ``outer``: the rows stay after
    the ``staging`` block they are written in.
    """
    return staged(df, name, outer)[0]


def staged(df: DataFrame, name: str, outer: bool = False) -> tuple[DataFrame, str]:
    """``stage`` and the folder, for ``remove_folder`` once nothing reads it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/staged/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    if len(_SCOPES) > outer:
        _SCOPES[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes in the block go as each write ends, not when the driver's heap is collected."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


_SCOPES: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what was staged inside the block when it ends.

    For work whose results are stored elsewhere before the block ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_folder(spark, path)


def use_skew_settings(spark: SparkSession) -> None:
    """Set the runtime settings that the joins on hot keys rely on."""
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        if spark.conf.get(key) != CLUSTER_DEFAULTS[key]:
            spark.conf.set(key, CLUSTER_DEFAULTS[key])
