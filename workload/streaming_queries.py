"""Streams (S7, F6, F7), run to the end of the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.functions.times import epoch_seconds
from catalink.session import scratch_path
from catalink.streaming import ddl, spool, windows
from workload.inputs import table
from workload.sql_inputs import CTES, with_ctes


def event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(path)


def notification_rows(events: DataFrame) -> DataFrame:
    """Events as DDL notifications of their user's database."""
    command = F.when(F.col("event_type") == "signup", "CREATE TABLE").when(F.col("event_type") == "error", "DROP TABLE").otherwise("ALTER TABLE")
    payload = F.struct(command.alias("command"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return events.select(
        "event_id", F.concat(F.lit("db_"), F.col("user_id").cast("string")).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.to_json(payload).alias("payload"),
    )


def observation_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", F.concat(F.lit("db_"), F.col("user_id").cast("string")).alias("source_id"),
        F.md5(F.col("event_type").cast("binary")).alias("fingerprint"),
    )


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def ddl_stream(spark, sf):
    root = scratch_path(spark, "ddl-stream")
    parsed = ddl.parse_notifications(notification_rows(_stream(spark, sf))).drop("ts")
    ddl.collect_notifications(parsed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{root}/out")


def ddl_spool(spark, sf):
    """Notifications that three writers' batches bring to a spool, read by a stream that starts anew after each of them."""
    root = scratch_path(spark, "ddl-spool")
    events = notification_rows(table(spark, sf, "events"))
    schema = events.schema
    for i in range(DELIVERIES):
        spool.append(events.filter(F.pmod("event_id", F.lit(DELIVERIES)) == i), f"{root}/spool", i)
        parsed = ddl.parse_notifications(spool.read_spool(spark, f"{root}/spool", schema, delete="true"))
        ddl.collect_notifications(parsed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{root}/out").select("event_id", "source_id", "command", "notified_at")


def drift_stream(spark, sf):
    root = scratch_path(spark, "drift-stream")
    ddl.detect_changes(observation_rows(_stream(spark, sf)), root, tie="event_id").awaitTermination()
    return ddl.read_changes(spark, root).select("event_id", "source_id", "fingerprint", "previous")


def ddl_to_refresh(spark, sf):
    root = scratch_path(spark, "refresh")

    def handler(requests: DataFrame, batch_id: int) -> None:
        requests.write.mode("overwrite").parquet(f"{root}/requests/batch={batch_id}")

    notifications = ddl.parse_notifications(notification_rows(_stream(spark, sf)))
    ddl.refresh_on_notification(notifications, handler, f"{root}/checkpoint", raise_errors=True).awaitTermination()
    return spark.read.parquet(f"{root}/requests").select("source_id", "notifications", "command")


DELIVERIES = 3


def drift_window_stream(spark, sf):
    """Poll windows of events that come in three deliveries, every tenth one delivery late; the streams start anew for each."""
    root = scratch_path(spark, "window-stream")
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    turn = F.floor(F.col("event_id") * DELIVERIES / (last + 1)) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    for i in range(DELIVERIES):
        events.filter(F.least(turn, F.lit(DELIVERIES - 1)) == i).write.mode("append").parquet(f"{root}/events")
        windows.poll_windows(observation_rows(event_stream(spark, f"{root}/events")), root, tie="event_id").awaitTermination()
    closed, late = windows.read_windows(spark, root), windows.read_late(spark, root)
    return closed.select(
        F.lit("window").alias("kind"), "source_id", epoch_seconds(closed, "window_start").alias("second"), "fingerprint", "observations"
    ).unionByName(late.select(
        F.lit("late").alias("kind"), "source_id", F.floor(epoch_seconds(late, "ts")).alias("second"), "fingerprint", F.col("event_id").alias("observations")
    ))


QUERIES = {"drift_window_stream": drift_window_stream, "ddl_stream": ddl_stream, "ddl_spool": ddl_spool, "drift_stream": drift_stream, "ddl_to_refresh": ddl_to_refresh}

CTES["w_rows"] = f"""
    SELECT event_id, 'db_' || user_id AS source_id, md5(event_type) AS fingerprint, ts, CAST(floor(epoch(ts) / 30) * 30 AS BIGINT) AS w,
           least(floor(event_id * {DELIVERIES} / ((SELECT max(event_id) FROM events) + 1)) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, {DELIVERIES - 1}) AS turn
    FROM events"""
CTES["w_marks"] = f"""
    SELECT t AS turn, (SELECT max(epoch(ts)) - {windows.DELAY_SECONDS} FROM w_rows r WHERE r.turn < t) AS mark
    FROM range({DELIVERIES + 1}) AS x(t)"""
CTES["w_split"] = """
    SELECT r.*, coalesce(w + 30 <= mark, FALSE) AS late FROM w_rows r JOIN w_marks USING (turn)"""
CTES["n_rows"] = """
    SELECT event_id, ts, 'db_' || user_id AS source_id, CASE event_type WHEN 'signup' THEN 'CREATE TABLE' WHEN 'error' THEN 'DROP TABLE' ELSE 'ALTER TABLE' END AS command,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS notified_at FROM events"""

ORACLES = {
    "drift_window_stream": with_ctes(f"""
        SELECT 'window' AS kind, source_id, w AS second, arg_max(fingerprint, (ts, event_id)) AS fingerprint, count(*) AS observations
        FROM w_split WHERE NOT late AND w + 30 <= (SELECT mark FROM w_marks WHERE turn = {DELIVERIES}) GROUP BY source_id, w
        UNION ALL SELECT 'late', source_id, CAST(floor(epoch(ts)) AS BIGINT), fingerprint, event_id FROM w_split WHERE late"""),
    "ddl_stream": with_ctes("SELECT event_id, source_id, command, notified_at FROM n_rows"),
    "ddl_spool": with_ctes("SELECT event_id, source_id, command, notified_at FROM n_rows"),
    "drift_stream": with_ctes("""
        SELECT event_id, source_id, fingerprint, previous FROM (
            SELECT event_id, 'db_' || user_id AS source_id, md5(event_type) AS fingerprint,
                   lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
        WHERE previous <> fingerprint"""),
    "ddl_to_refresh": with_ctes("""
        SELECT source_id, count(*) AS notifications, arg_max(command, (ts, command)) AS command FROM n_rows GROUP BY ALL"""),
}
