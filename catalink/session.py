"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "catalink", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh temporary one only for an unset local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="catalink-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later plans do not recompute it.

    The written table survives the loss of executors, unlike a cached or locally checkpointed one.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: both sides are shuffled and merged, neither goes to the driver.

    Spark takes a side for small by its compressed files or by the rows before ``inline``, either far below its size in memory.
    """
    return df.hint("merge")


SENT_ROWS = 20_000  # rows of a narrow side that is sent to every task


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a narrow side of a join: sent to every task while it has few rows, merged as ``grown`` once it has more.

    Counted, as a join on few values, such as one database, would bring all rows of the other side into few tasks. ``df`` should be stored.
    """
    rows = SENT_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else grown(df)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows dealt out over all cores when the input has fewer splits than that; else ``df`` as it is.

    For work that is heavy per row over a small or unsplittable file. Large inputs have many splits and do not shuffle, unless ``rows``
    bounds what a task takes on average: the splits of a file are as few as the cores and grow with it.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        tasks = max(tasks, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
