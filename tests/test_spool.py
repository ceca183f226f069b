import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.streaming import ddl, spool

ROW = "id long, source_id string, ts timestamp, payload string"


def rows(spark, first, last):
    return spark.range(first, last).selectExpr(
        "id", "if(id % 3 = 0, null, concat('s', id % 2)) AS source_id", "timestamp_seconds(id) AS ts", "concat('p', id) AS payload"
    )


def drained(spark, folder, **options):
    stream = spool.read_spool(spark, f"{folder}/spool", ROW, **options)
    query = ddl.collect_notifications(stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return query


def seen(spark, folder):
    return sorted((r.id, r.source_id, r.ts, r.payload) for r in spark.read.schema(ROW).parquet(f"{folder}/out").collect())


def wanted(spark, last):
    return sorted((r.id, r.source_id, r.ts, r.payload) for r in rows(spark, 0, last).collect())


@pytest.mark.parametrize("delete", ["false", "true"])
def test_rows_come_once_over_restarts_and_gaps_are_waited_for(spark, tmp_path, delete):
    folder = str(tmp_path)
    drained(spark, folder, delete=delete)  # nothing there yet
    spool.append(rows(spark, 0, 50), f"{folder}/spool", 0)
    spool.append(rows(spark, 0, 50), f"{folder}/spool", 0)  # a writer's replay
    drained(spark, folder, delete=delete)
    assert seen(spark, folder) == wanted(spark, 50)
    spool.append(rows(spark, 90, 100), f"{folder}/spool", 3)
    spool.append(rows(spark, 50, 60), f"{folder}/spool", 1)
    drained(spark, folder, delete=delete)
    assert seen(spark, folder) == wanted(spark, 60)  # batch 3 is not passed on before batch 2 is there
    spool.append(rows(spark, 60, 90), f"{folder}/spool", 2)
    drained(spark, folder, delete=delete)
    drained(spark, folder, delete=delete)
    assert seen(spark, folder) == wanted(spark, 100)
    left = {name for name in os.listdir(f"{folder}/spool") if name.startswith("batch=")}
    if delete == "false":
        assert left == {f"batch={n}" for n in range(4)} and spool.consumed(f"{folder}/spool") == 0
    else:
        assert "batch=0" not in left and "batch=1" not in left
        before = spool.consumed(f"{folder}/spool")
        assert before >= 2
        spool.append(rows(spark, 0, 50), f"{folder}/spool", 0)  # a replay of what is consumed already
        drained(spark, folder, delete=delete)
        assert seen(spark, folder) == wanted(spark, 100)


def test_a_failed_batch_is_read_again_whole(spark, tmp_path):
    folder, tries = str(tmp_path), []

    def step(batch, number):
        tries.append(number)
        if len(tries) == 2:
            batch.limit(3).collect()
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    def run():
        ddl.start(spool.read_spool(spark, f"{folder}/spool", ROW, delete="true"), step, f"{folder}/checkpoint", None).awaitTermination()

    spool.append(rows(spark, 0, 20), f"{folder}/spool", 0)
    run()
    spool.append(rows(spark, 20, 70), f"{folder}/spool", 1)
    with pytest.raises(Exception, match="lost"):
        run()
    spool.append(rows(spark, 70, 75), f"{folder}/spool", 2)
    run()
    run()
    assert tries == [0, 1, 1, 2] and seen(spark, folder) == wanted(spark, 75)


def test_two_streams_read_one_spool(spark, tmp_path):
    spool.append(rows(spark, 0, 30), f"{tmp_path}/spool", 0)
    for name in "ab":
        stream = spool.read_spool(spark, f"file:{tmp_path}/spool", ROW)
        ddl.collect_notifications(stream, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/checkpoint").awaitTermination()
        assert seen(spark, f"{tmp_path}/{name}") == wanted(spark, 30)


def test_a_large_file_is_read_by_many_tasks_and_each_row_once(spark, tmp_path):
    path = tmp_path / "spool" / "batch=0"
    path.mkdir(parents=True)
    table = pa.table({"id": range(5000), "payload": [f"p{i}" * 9 for i in range(5000)], "more": [1] * 5000})
    pq.write_table(table, path / "part-0.parquet", row_group_size=250)
    pq.write_table(table.slice(0, 0), path / "part-1.parquet")
    reader = spool.SpoolReader(T.StructType.fromDDL(ROW), str(tmp_path / "spool"), 20_000, False)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    size = (path / "part-0.parquet").stat().st_size
    assert len(parts) >= size // 20_000 and all(sum(hi - lo for _, lo, hi in p.ranges) <= 20_000 for p in parts)
    got = [batch for part in parts for batch in reader.read(part)]
    assert sorted(i for batch in got for i in batch.column("id").to_pylist()) == list(range(5000))
    assert all(batch.schema.names == ["id", "source_id", "ts", "payload"] for batch in got)
    assert got[0].column("source_id").null_count == got[0].num_rows
    assert max(sum(b.num_rows for b in reader.read(p)) for p in parts) < 2500


def test_small_files_share_a_split():
    parts = spool.splits([(f"f{i}", 10) for i in range(95)] + [("big", 250), ("none", 0)], 100)
    ranges = [r for p in parts for r in p.ranges]
    assert len(parts) <= 14 and sum(hi - lo for _, lo, hi in ranges) == 95 * 10 + 250 and len(set(ranges)) == len(ranges)


def test_a_batch_that_went_before_it_was_read_stops_the_stream(spark, tmp_path):
    for number in range(2):
        spool.append(rows(spark, 0, 5), f"{tmp_path}/spool", number)
    reader = spool.SpoolReader(T.StructType.fromDDL(ROW), f"{tmp_path}/spool", 1000, False)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"next": 2}
    shutil.move(f"{tmp_path}/spool/batch=1", f"{tmp_path}/elsewhere")
    with pytest.raises(RuntimeError, match="batch 1"):
        reader.partitions(start, end)


def test_the_usual_schema_and_payloads(spark, tmp_path):
    raw = spark.createDataFrame([("a", '{"command": "DROP TABLE", "timestamp": "t"}'), ("b", "x" * 200_000), (None, None)], "source_id string, payload string")
    spool.append(raw.withColumn("extra", F.lit(1)), f"{tmp_path}/spool", 0)
    stream = ddl.parse_notifications(spool.read_spool(spark, f"{tmp_path}/spool"))
    ddl.collect_notifications(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.select("source_id", "command", "ts").collect())) == sorted(
        ["Row(source_id='a', command='DROP TABLE', ts=None)", "Row(source_id='b', command=None, ts=None)", "Row(source_id=None, command=None, ts=None)"]
    )
