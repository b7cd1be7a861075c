"""Cluster-side helpers: shared work folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROW_BOUND = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder set, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="logwarden-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """A table whose rows a configured cap (or a file listing) bounds, as a literal relation.

    Later queries then see a handful of local rows instead of the scan behind them.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def spread(df: DataFrame) -> DataFrame:
    """More tasks for costly row-local work when a scan yields fewer splits than there are cores.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, task_rows: int = 50_000) -> DataFrame:
    """``df`` dealt by ``key`` over tasks of about ``task_rows`` rows, for work that costs much a row.

    The splits of a scan do not bound a task: a row group goes whole to one of them, and the others are empty. ``df`` is a
    plain scan, so that the count is read from the footers of its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // task_rows)), key)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back (columnar, pruned on read)."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """Broadcast hint only when a count proves at most ``max_rows``; otherwise Spark picks the join.

    The count reads at most ``max_rows + 1`` rows per partition; beyond the bound the join falls
    back to a shuffle join, where adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
