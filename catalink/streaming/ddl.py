"""Streams of schema changes: DDL notifications, stateful change detection, refresh requests.

Sinks are Spark's file sink, or ``foreachBatch`` with output keyed by batch id: a replayed batch meets its own files, so
every batch counts exactly once however often it is tried.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from catalink.operators import drift
from catalink.session import cut

log = logging.getLogger(__name__)

PAYLOAD = "command string, timestamp string"


def read_notifications(spark: SparkSession, fmt: str, schema: T.StructType | str | None = None, path: str | None = None, **options: str) -> DataFrame:
    """Any streaming source of rows with ``source_id``, ``ts`` and a JSON ``payload`` (file, kafka, ...)."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def parse_notifications(raw: DataFrame) -> DataFrame:
    """``command`` and ``notified_at`` out of the payload; an unreadable payload still counts as a notification."""
    parsed = F.from_json(F.col("payload").cast("string"), PAYLOAD)
    return raw.withColumn("command", parsed["command"]).withColumn("notified_at", parsed["timestamp"]).drop("payload")


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def collect_notifications(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append parsed notifications to a parquet table through Spark's own exactly-once file sink."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastValue(StatefulProcessor):
    """The last known value of each source with the batch that brought it; gives back first looks that differ from it.

    One row per source and batch comes in. Rows of a batch that was seen before are ignored, so a batch that is written
    again counts once. With ``ttl_ms`` a source that is silent for longer is forgotten, and its next look is a first one.
    """

    def __init__(self, value: str, state: T.StructType, out: T.StructType, ttl_ms: int | None):
        self.value, self.state, self.out, self.ttl_ms = value, state, out, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", self.state, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        known = self.known.get()
        previous, seen = known if known is not None else (None, -1)
        for row in sorted(rows, key=lambda r: r["batch"]):
            if row["batch"] <= seen:
                continue
            if previous is not None and previous != row[self.value]:
                cells = row.asDict() | {"previous": previous}
                yield Row(**{name: cells[name] for name in self.out.names})
            previous, seen = row["last_value"], row["batch"]
        self.known.update((previous, seen))

    def close(self) -> None:
        pass


def published(spark: SparkSession, folder: str, batch_id: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def published_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream of the published batches, from before the first of them on; files that were read are deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(schema).option("cleanSource", "delete").parquet(folder)


def publish(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Write a batch beside ``folder`` and rename it into it, so that a stream that reads the folder sees all of it or nothing.

    The folder needs atomic renames, as a stream's checkpoint folder does.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}-staged/batch={batch_id}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    if not files.rename(path(f"{folder}-staged/batch={batch_id}"), path(f"{folder}/batch={batch_id}")):
        raise OSError(f"batch {batch_id} could not be published in {folder}")


def change_step(root: str, key: str = "source_id", ts: str = "ts", value: str = "fingerprint", tie: str | None = None) -> Callable[[DataFrame, int], None]:
    """One micro-batch of the change detector, as far as it needs no state.

    Changes inside the batch are found by the skew-safe comparison of ``drift.with_previous``. What is left is one row
    per source, its first known look and its last value, in ``root/heads``: a source that owns a third of all looks costs
    the state as much as any other.
    """
    order = [ts] if tie is None else [ts, tie]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if published(spark, f"{root}/heads", batch_id):  # a replay; its files may have been read, and removed, already
            return
        seen = cut(drift.with_previous(batch, key, ts, value, tie), f"batch-{batch_id}").filter(F.col(value).isNotNull())
        changed = seen.filter(F.col("previous") != F.col(value))
        changed.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
        latest = seen.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last_value"))
        first = seen.filter(F.col("previous").isNull()).drop("previous")
        publish(first.join(latest, key), f"{root}/heads", batch_id)

    return step


def _typed(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(*field) for field in more)])


def compare_heads(
    spark: SparkSession, schema: T.StructType, root: str, key: str = "source_id", value: str = "fingerprint",
    ttl_ms: int | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Compare the first look of each source in a batch with the last value of earlier batches, kept in a RocksDB state store.

    ``schema`` is that of the observations. A batch touches the state of the sources in it and of no other; heads that
    were compared are deleted by the file source.
    """
    kind = schema[value].dataType
    heads = _typed(schema, ("last_value", kind), ("batch", T.IntegerType()))
    out = _typed(schema, ("previous", kind), ("batch", T.IntegerType()))
    state = T.StructType([T.StructField("value", kind), T.StructField("batch", T.IntegerType())])
    compared = (
        published_batches(spark, f"{root}/heads", heads)
        .groupBy(key)
        .transformWithState(LastValue(value, state, out, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime")
    )
    return start_stateful(compared, f"{root}/across", f"{root}/checkpoint-state", interval)


def start_stateful(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append the stream to a parquet table, with its state in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # a query keeps the settings it starts with
    try:
        return collect_notifications(stream, out, checkpoint, interval)
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


@dataclass
class TwoQueries:
    """One query prepares each batch, the other holds the state. Without an interval the second starts when the first is done."""

    preparing: StreamingQuery
    stateful: Callable[[], StreamingQuery]
    running: StreamingQuery | None = None

    def awaitTermination(self) -> None:
        self.preparing.awaitTermination()
        self.running = self.running or self.stateful()
        self.running.awaitTermination()

    def stop(self) -> None:
        self.preparing.stop()
        if self.running:
            self.running.stop()


def detect_changes(
    observations: DataFrame,
    root: str,
    key: str = "source_id",
    ts: str = "ts",
    value: str = "fingerprint",
    tie: str | None = None,
    interval: str | None = None,
    ttl_ms: int | None = None,
) -> TwoQueries:
    """Remember the last fingerprint per source and write only changes; ``read_changes`` reads them."""
    spark, schema = observations.sparkSession, observations.schema
    preparing = start(observations, change_step(root, key, ts, value, tie), f"{root}/checkpoint", interval)

    def comparing() -> StreamingQuery:
        return compare_heads(spark, schema, root, key, value, ttl_ms, interval)

    return TwoQueries(preparing, comparing, comparing() if interval else None)


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """All changes found so far: inside a batch, and between a batch and the ones before. Needs a first batch, also an empty one."""
    inside = spark.read.parquet(f"{root}/changes")
    try:
        across = spark.read.schema(inside.schema).parquet(f"{root}/across")
    except AnalysisException:
        return inside
    return inside.unionByName(across)


Handler = Callable[[DataFrame, int], None]
REQUEST = "source_id string, last_ts timestamp, notifications long, command string"


def _pending(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Requests that the last earlier batch left undone; each batch's folder is its own, so a replayed batch reads the same."""
    try:
        left = spark.read.schema(REQUEST + ", batch int").parquet(path).filter(F.col("batch") < batch_id)
        newest = left.agg(F.max("batch")).first()[0]
    except AnalysisException:
        return None
    return None if newest is None else left.filter((F.col("batch") == newest) & F.col("source_id").isNotNull()).drop("batch")


def refresh_step(handler: Handler, raise_errors: bool = False, pending: str | None = None) -> Handler:
    """Collapse a batch of notifications to one request per source and hand it on.

    Batches run one after the other, so refreshes never overlap. A failing refresh is logged and the stream goes on;
    ``raise_errors`` stops the stream instead. With a ``pending`` folder its requests are offered again with the next batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        requests = drift.latest_notifications(batch)
        before = _pending(spark, pending, batch_id) if pending else None
        if before is not None:
            both = requests.unionByName(before)
            requests = both.groupBy("source_id").agg(
                F.max("last_ts").alias("last_ts"), F.sum("notifications").alias("notifications"),
                F.max_by("command", F.struct("last_ts", "command")).alias("command"),
            )
        requests = cut(requests, f"requests-{batch_id}")
        failed = False
        try:
            handler(requests, batch_id)
        except Exception:
            if raise_errors:
                raise
            failed = True
            log.exception("refresh failed for batch %s", batch_id)
        if pending and (failed or before is not None):
            # A batch with nothing left still says so, by a row without a source.
            nothing = spark.range(1).select(*(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in REQUEST.split(", "))))
            (requests if failed else nothing).write.mode("overwrite").parquet(f"{pending}/batch={batch_id}")

    return step


def refresh_on_notification(
    notifications: DataFrame, handler: Handler, checkpoint: str, interval: str | None = None, raise_errors: bool = False
) -> StreamingQuery:
    """Drive ``handler`` from a notification stream. Every notification counts, however late; a batch makes one request per source."""
    step = refresh_step(handler, raise_errors, f"{checkpoint}-pending")
    return start(notifications, step, checkpoint, interval)
