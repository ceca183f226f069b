import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.operators import drift
from catalink.streaming import ddl, windows
from tests.conftest import SMALL
from workload.streaming_queries import event_stream, notification_rows, observation_rows


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in five files, in time order, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(5):
        part = events.filter(F.floor(F.col("event_id") * 5 / (last + 1)) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return path, events


LOOK = "event_id long, source_id string, s int, fingerprint string, ts timestamp"


def carry_over(spark, root, **options):
    """Run the stateful half over what the steps have left."""
    query = ddl.compare_heads(spark, T.StructType.fromDDL(LOOK), str(root), **options)
    query.awaitTermination()
    return query


def key(df):
    return sorted((r.event_id, r.source_id, r.fingerprint, r.previous) for r in df.collect())


def test_change_stream_equals_the_batch_twin(spark, split_events, tmp_path):
    path, events = split_events
    stream = observation_rows(event_stream(spark, path, maxFilesPerTrigger="1"))
    ddl.detect_changes(stream, str(tmp_path), tie="event_id").awaitTermination()
    assert len(list(tmp_path.glob("heads/batch=*"))) == 5
    got = ddl.read_changes(spark, str(tmp_path)).select("event_id", "source_id", "fingerprint", "previous")
    want = drift.changes(observation_rows(events), tie="event_id").select("event_id", "source_id", "fingerprint", "previous")
    assert key(got) == key(want)
    when = lambda df: sorted((r.event_id, r.ts) for r in df.select("event_id", "ts").collect())
    assert when(ddl.read_changes(spark, str(tmp_path))) == when(drift.changes(observation_rows(events), tie="event_id"))
    # Nothing new: a restart from the same checkpoint adds nothing.
    ddl.detect_changes(stream, str(tmp_path), tie="event_id").awaitTermination()
    assert key(ddl.read_changes(spark, str(tmp_path)).select("event_id", "source_id", "fingerprint", "previous")) == key(want)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    step = ddl.change_step(str(tmp_path), tie="event_id")
    schema = "event_id long, source_id string, s int, fingerprint string"

    def batch(rows):
        return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))

    step(batch([(1, "a", 1, "x"), (2, "b", 1, "x")]), 0)
    for _ in range(2):
        step(batch([(3, "a", 2, "y"), (4, "b", 2, "x"), (5, "c", 2, "x")]), 1)
    step(batch([(6, "c", 3, "z")]), 2)
    carry_over(spark, tmp_path)
    assert key(ddl.read_changes(spark, str(tmp_path))) == [(3, "a", "y", "x"), (6, "c", "z", "x")]


def test_the_state_is_touched_for_the_sources_of_a_batch_only(spark, tmp_path):
    step = ddl.change_step(str(tmp_path), tie="event_id")
    first = spark.range(600).selectExpr("id AS event_id", "concat('s', id % 200) AS source_id", "1 AS s", "'x' AS fingerprint", "timestamp_seconds(id) AS ts")
    step(first, 0)
    rows = [p.stateOperators[0] for p in carry_over(spark, tmp_path).recentProgress if p.numInputRows]
    assert (rows[0].numRowsTotal, rows[0].numRowsUpdated) == (200, 200)
    # A hot source owns nearly all looks of the second batch; the state sees one row of it.
    hot = spark.range(3000).selectExpr("10000 + id AS event_id", "if(id < 2990, 's1', concat('s', id % 3)) AS source_id", "1 AS s", "if(id < 5, 'x', 'y') AS fingerprint", "timestamp_seconds(10000 + id) AS ts")
    step(hot, 1)
    query = carry_over(spark, tmp_path)
    rows = [p for p in query.recentProgress if p.numInputRows]
    assert rows[0].numInputRows == 3 and rows[0].stateOperators[0].numRowsUpdated == 3 and rows[0].stateOperators[0].numRowsTotal == 200
    want = drift.changes(first.unionByName(hot), tie="event_id")
    assert key(ddl.read_changes(spark, str(tmp_path))) == key(want)
    assert want.count() == 3


def test_heads_written_again_and_extra_columns(spark, tmp_path):
    """Heads that come a second time, after they were compared already, change nothing."""
    step = ddl.change_step(str(tmp_path), tie="event_id")
    looks = "event_id long, source_id string, s int, fingerprint string"
    rows = [spark.createDataFrame(r, looks).withColumn("ts", F.timestamp_seconds("s")) for r in ([(1, "a", 1, "x")], [(2, "a", 2, "y")])]
    for number, batch in enumerate(rows):
        step(batch, number)
        carry_over(spark, tmp_path)
    (tmp_path / "heads/batch=1").rename(tmp_path / "compared")
    step(rows[1], 1)
    carry_over(spark, tmp_path)
    assert key(ddl.read_changes(spark, str(tmp_path))) == [(2, "a", "y", "x")]


def test_notifications_collapse_and_errors_do_not_stop_the_stream(spark, split_events, tmp_path):
    path, events = split_events
    calls, done = [], []

    def handler(requests, batch_id):
        calls.append(batch_id)
        if len(calls) in (2, 3):
            raise RuntimeError("refresh failed")
        done.append(sum(r.notifications for r in requests.collect()))

    stream = ddl.parse_notifications(notification_rows(event_stream(spark, path, maxFilesPerTrigger="1")))
    ddl.refresh_on_notification(stream, handler, f"{tmp_path}/c").awaitTermination()
    # What failed twice was offered again; no notification, however late, is left out.
    assert sum(done) == events.count() and len(calls) >= 5 and len(done) == len(calls) - 2
    with pytest.raises(RuntimeError):
        ddl.refresh_step(handler_raises, raise_errors=True)(spark.createDataFrame([("a", 1, "x")], "source_id string, ts int, command string"), 0)


def handler_raises(requests, batch_id):
    raise RuntimeError("no")


def test_a_failed_look_is_no_change_and_hides_none(spark, tmp_path):
    looks = [(1, "a", 1, "x"), (2, "a", 2, None), (3, "a", 3, "y"), (4, "a", 4, None), (5, "a", 40_000, None), (6, "a", 80_000, "y"), (7, "a", 90_000, "z"), (8, "b", 1, None), (9, "b", 2, "q")]
    want = [(3, "a", "y", "x"), (7, "a", "z", "y")]

    def batch(rows):
        return spark.createDataFrame(rows, "event_id long, source_id string, s int, fingerprint string").withColumn("ts", F.timestamp_seconds("s"))

    assert key(drift.changes(batch(looks), tie="event_id")) == want
    step = ddl.change_step(str(tmp_path), tie="event_id")
    for i in range(0, len(looks), 2):
        step(batch(looks[i : i + 2]), i // 2)
        if i == 4:  # the state outlives its query
            carry_over(spark, tmp_path)
    carry_over(spark, tmp_path)
    assert key(ddl.read_changes(spark, str(tmp_path))) == want


def test_late_notifications_make_requests(spark, tmp_path):
    asked = []
    step = ddl.refresh_step(lambda requests, batch_id: asked.extend(r.source_id for r in requests.collect()), pending=f"{tmp_path}/p")
    for number, second in enumerate((1_000_000, 5, 5)):  # the second is days late, the third a repetition
        rows = spark.createDataFrame([("a", "ALTER TABLE")], "source_id string, command string").withColumn("ts", F.timestamp_seconds(F.lit(second)))
        step(rows, number)
    assert asked == ["a", "a", "a"]


def test_payload_parsing(spark):
    raw = spark.createDataFrame([("a", '{"command": "ALTER TABLE", "timestamp": "t"}'), ("b", "garbage"), ("c", None)], "source_id string, payload string")
    assert {r.source_id: r.command for r in ddl.parse_notifications(raw).collect()} == {"a": "ALTER TABLE", "b": None, "c": None}


def test_windows_close_behind_the_watermark_and_late_looks_stand_aside(spark, tmp_path):
    """Every look is in one closed window, in one that is still open, or in the side table; over restarts and a replay."""
    deliveries = [
        [(1, "a", 3, "x"), (2, "a", 29, "y"), (3, "b", 31, "x"), (4, "a", 100, "x")],
        [(5, "a", 29, "late"), (6, "a", 70, "in time"), (7, "a", 99, "first"), (8, "b", None, "no time"), (9, "a", 100, "y"), (10, "b", 300, None)],
        [(11, "a", 239, "late"), (12, "a", 240, "z"), (13, "b", 300, "q"), (14, "b", 1, "late"), (15, "c", 400, "open")],
        [],
    ]
    schema = "event_id long, source_id string, s long, fingerprint string"
    step = windows.window_step(str(tmp_path), tie="event_id", delay=50)
    looks = []
    for number, rows in enumerate(deliveries):
        batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
        looks += rows
        for _ in range(1 + number % 2):
            step(batch, number)
            windows.close_windows(spark, batch.schema, str(tmp_path), tie="event_id", delay=50).awaitTermination()
    late = sorted(r.event_id for r in windows.read_late(spark, str(tmp_path)).collect())
    assert late == [5, 8, 11, 14]
    timely = spark.createDataFrame([r for r in looks if r[0] not in late], schema).withColumn("ts", F.timestamp_seconds("s"))
    ended = drift.poll_windows(timely, tie="event_id").filter(F.col("window_end") <= F.timestamp_seconds(F.lit(400 - 50)))
    rows = lambda df: sorted(map(str, df.select("source_id", "window_start", "window_end", "fingerprint", "observations").collect()))
    assert rows(windows.read_windows(spark, str(tmp_path))) == rows(ended)
    assert ended.agg(F.sum("observations")).first()[0] + len(late) + 1 == len(looks)


def test_windows_of_a_hot_source_reach_the_state_as_one_row(spark, tmp_path):
    step = windows.window_step(str(tmp_path), delay=50)
    hot = spark.range(5000).selectExpr("if(id % 50 = 0, 's2', 's1') AS source_id", "timestamp_seconds(id % 60) AS ts", "string(id % 60) AS fingerprint")
    step(hot, 0)
    query = windows.close_windows(spark, hot.schema, str(tmp_path), delay=50)
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 4
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 4


def test_both_streams_run_side_by_side(spark, tmp_path):
    """With an interval the stateful queries start before anything is published; empty batches are batches as well."""
    schema = "event_id long, source_id string, s long, fingerprint string, ts timestamp"

    def deliver(rows):
        looks = spark.createDataFrame(rows, "event_id long, source_id string, s long, fingerprint string")
        looks.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    both = [
        ddl.detect_changes(stream, f"{tmp_path}/c", tie="event_id", interval="200 milliseconds"),
        windows.poll_windows(stream, f"{tmp_path}/w", tie="event_id", delay=50, interval="200 milliseconds"),
    ]
    try:
        for rows in ([], [(1, "a", 1, "x"), (2, "a", 2, "y")], [(3, "a", 95, "z"), (4, "b", 99, "x")], [(5, "a", 3, "late")]):
            deliver(rows)
            for queries in both:
                queries.preparing.processAllAvailable()
                queries.running.processAllAvailable()
    finally:
        for queries in both:
            queries.stop()
    assert key(ddl.read_changes(spark, f"{tmp_path}/c")) == [(2, "a", "y", "x"), (3, "a", "z", "y"), (5, "a", "late", "z")]
    closed = windows.read_windows(spark, f"{tmp_path}/w").collect()
    assert [(r.source_id, r.fingerprint, r.observations) for r in closed] == [("a", "y", 2)]
    assert [r.event_id for r in windows.read_late(spark, f"{tmp_path}/w").collect()] == [5]
