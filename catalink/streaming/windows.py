"""Poll windows of an endless stream: a watermark closes them, looks that come too late are kept aside.

A look is late when its window had ended at the watermark that the batches before it have set. Spark drops such rows from
a windowed aggregate without a trace, so a first query separates them and hands on, per batch, one row of each source and
window; a second query holds the open windows in its state. A batch is published as a whole, so what the first query calls
timely is never behind the watermark of the second: that one has seen earlier batches only, and no later look than they hold.
Every look is thus counted in one window or stands in the side table. Looks without a time stand in the side table.
A time without a zone is read in the session's zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from catalink.operators.drift import POLL_SECONDS
from catalink.session import cut
from catalink.streaming.ddl import TwoQueries, publish, published, published_batches, start, start_stateful

DELAY_SECONDS = 600


def _microseconds(seconds: int) -> int:
    return seconds * 1_000_000


def window_step(
    root: str, key: str = "source_id", ts: str = "ts", value: str = "fingerprint", tie: str | None = None,
    seconds: int = POLL_SECONDS, delay: int = DELAY_SECONDS,
) -> Callable[[DataFrame, int], None]:
    """One micro-batch: late looks to ``root/late``, one row per source and window to ``root/parts``.

    ``root/marks`` holds the greatest time seen up to each batch, in microseconds.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if published(spark, f"{root}/parts", batch_id):
            return
        greatest = None
        if batch_id:
            greatest = spark.read.schema("greatest long").parquet(f"{root}/marks/batch={batch_id - 1}").first()["greatest"]
        end = (F.floor(F.col("__at") / _microseconds(seconds)) + 1) * _microseconds(seconds)
        seen = cut(batch.withColumn("__at", at).withColumn("__end", end), f"looks-{batch_id}")
        behind = F.lit(False) if greatest is None else F.col("__end") <= greatest - _microseconds(delay)
        late = F.col("__at").isNull() | behind
        seen.filter(late).drop("__at", "__end").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        seen.agg(F.greatest(F.max("__at"), F.lit(greatest).cast("long")).alias("greatest")).write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")
        latest = F.struct("__at") if tie is None else F.struct("__at", F.col(tie).alias("tie"))
        parts = seen.filter(~late).groupBy(F.col(key).alias("key"), "__end").agg(
            F.timestamp_micros(F.max("__at")).alias("at"), F.max(latest).alias("latest"),
            F.max_by(value, latest).alias("value"), F.count(F.lit(1)).alias("n"),
        )
        publish(parts.drop("__end"), f"{root}/parts", batch_id)

    return step


def close_windows(
    spark: SparkSession, schema: T.StructType, root: str, key: str = "source_id", value: str = "fingerprint", tie: str | None = None,
    seconds: int = POLL_SECONDS, delay: int = DELAY_SECONDS, interval: str | None = None,
) -> StreamingQuery:
    """Put the parts of each window together and write it to ``root/windows`` once the watermark has passed its end."""
    latest = T.StructType([T.StructField("__at", T.LongType())] + ([] if tie is None else [T.StructField("tie", schema[tie].dataType)]))
    fields = [("key", schema[key].dataType), ("at", T.TimestampType()), ("latest", latest), ("value", schema[value].dataType), ("n", T.LongType()), ("batch", T.IntegerType())]
    closed = (
        published_batches(spark, f"{root}/parts", T.StructType([T.StructField(*f) for f in fields]))
        .withWatermark("at", f"{delay} seconds")
        .groupBy("key", F.window("at", f"{seconds} seconds").alias("w"))
        .agg(F.max_by("value", "latest").alias(value), F.sum("n").alias("observations"))
        .select(F.col("key").alias(key), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), value, "observations")
    )
    return start_stateful(closed, f"{root}/windows", f"{root}/checkpoint-state", interval)


def poll_windows(
    observations: DataFrame, root: str, key: str = "source_id", ts: str = "ts", value: str = "fingerprint", tie: str | None = None,
    seconds: int = POLL_SECONDS, delay: int = DELAY_SECONDS, interval: str | None = None,
) -> TwoQueries:
    """Streaming form of ``drift.poll_windows``; ``read_windows`` and ``read_late`` read what it writes."""
    spark, schema = observations.sparkSession, observations.schema

    def closing() -> StreamingQuery:
        return close_windows(spark, schema, root, key, value, tie, seconds, delay, interval)

    preparing = start(observations, window_step(root, key, ts, value, tie, seconds, delay), f"{root}/checkpoint", interval)
    return TwoQueries(preparing, closing, closing() if interval else None)


def read_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows closed so far. Needs a first batch, also an empty one."""
    return spark.read.parquet(f"{root}/windows")


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """Late looks as they came, with the ``batch`` that brought them."""
    return spark.read.parquet(f"{root}/late")
