"""Spark session and checkpoint helpers.

On a cluster the session is created by the platform; ``checkpoint_dir``
only reads the shared folder that ``spark.checkpoint.dir`` names there.
A local folder is created only when the setting is absent (tests, bench).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexiprop") -> SparkSession:
    """Session for tests and local benchmarking (UI off, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    Uses ``spark.checkpoint.dir`` (or a folder already set on the context);
    creates a fresh local one only in local mode, when neither is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookup differences
            configured = None
    if not configured:
        # executors of a cluster would each write to a disk of their own
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lexiprop-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries planned in here remove their shuffle files as soon as they have run."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder and drop its lineage.

    Survives executor loss (unlike a local checkpoint): the data lives in the
    shared checkpoint folder, not in executor block managers. The shuffle files of the work
    go with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with _shuffles_freed(spark):
        own = df.select("*")  # planned for this run only, so nobody else reads its shuffles
    return own.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Remove the files of ``cut_lineage`` results that nobody reads any more."""
    for df in tables:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def stored(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet (by the folders of ``by``) below the checkpoint folder, and the path.

    For large tables: smaller than a checkpoint, and read by column. Shuffle files go as with ``cut_lineage``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the library's own below the checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
