"""Session helpers: settings that every job of the package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Sides joined without an equality key are collected only up to this many rows.
SMALL_SIDE_ROWS = 100_000


def local_session(cpus: str | int = "*", app: str = "sweeploom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A temporary folder is made only for a session on one machine; on a cluster
    it would be the driver's alone.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder.

    The folder named by the cluster wins; a temporary one is used only where
    the session names none, as in tests.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a columnar table below the shared folder and read it again.

    It cuts the lineage as :func:`checkpointed` does, takes a fraction of its
    disk, and later jobs read only the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, limit: int = SMALL_SIDE_ROWS, what: str = "side") -> list:
    """Rows of a side that must be small; its size is checked, never assumed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and cannot be shared with every task")
    return rows


def is_small(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def broadcast_small(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Hint a broadcast when the row count is within ``limit``; else leave the
    choice of join to the optimizer."""
    return F.broadcast(df) if is_small(df, limit) else df
