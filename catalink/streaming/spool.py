"""Notifications spooled in a shared folder, as a streaming source with offsets, splits and commits.

A spool holds numbered batches, each renamed into it at once (``append``). The offset of a stream is the number of the
first batch that it has not read; only batches without a gap before them are offered, so one that is published late is
waited for and never passed over. A batch that is tried again reads the same batches, which are deleted (if they are at
all) only when Spark says that a later offset is committed. A gap inside a range that was promised is an error.

Batches are split by bytes, not by source or file: a file larger than ``split`` is read by several tasks, small files
share one, and a task holds one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from catalink.streaming import ddl

SPLIT_BYTES = 64 << 20
PROBED = 64  # batches asked for in one call
ROWS = 10_000  # rows of an Arrow batch


def append(rows: DataFrame, spool: str, number: int) -> None:
    """Publish ``rows`` as batch ``number``; a number that is there or was consumed already is left as it is.

    Numbers count up from 0. A writer that is a stream itself passes its batch id, so a replayed batch counts once.
    """
    if number >= consumed(spool) and not ddl.published(rows.sparkSession, spool, number):
        ddl.publish(rows, spool, number)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that is named as Spark names it."""
    scheme, colon, rest = path.partition(":/")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path.rstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    found, inner = fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme}:/{rest}")
    return found, inner.rstrip("/")


def consumed(spool: str) -> int:
    """The first batch that was not given back by ``commit``."""
    files, folder = opened(spool)
    marks = files.get_file_info(fs.FileSelector(f"{folder}/_consumed", allow_not_found=True))
    return max((int(mark.base_name) for mark in marks), default=0)


@dataclass
class Split(InputPartition):
    """Byte ranges of files: path, first and last byte."""

    ranges: tuple[tuple[str, int, int], ...]


def splits(files: list[tuple[str, int]], size: int) -> list[Split]:
    """All files cut into ranges of at most ``size`` bytes, small ranges put together up to it."""
    ranges = [(path, lo, min(lo + size, length)) for path, length in files for lo in range(0, length, size)]
    out: list[list[tuple[str, int, int]]] = []
    held = size
    for path, lo, hi in ranges:
        if held + hi - lo > size:
            out.append([])
            held = 0
        out[-1].append((path, lo, hi))
        held += hi - lo
    return [Split(tuple(part)) for part in out]


class SpoolReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, spool: str, split: int, delete: bool):
        self.schema, self.spool, self.split, self.delete = schema, spool, split, delete
        self.next = consumed(spool)

    def initialOffset(self) -> dict:
        return {"next": consumed(self.spool)}

    def latestOffset(self) -> dict:
        files, folder = opened(self.spool)
        while True:
            found = files.get_file_info([f"{folder}/batch={n}" for n in range(self.next, self.next + PROBED)])
            run = next((i for i, info in enumerate(found) if info.type == fs.FileType.NotFound), PROBED)
            self.next += run
            if run < PROBED:
                return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.next = max(self.next, end["next"])
        files, folder = opened(self.spool)
        found = []
        for number in range(start["next"], end["next"]):
            try:
                batch = files.get_file_info(fs.FileSelector(f"{folder}/batch={number}", recursive=True))
            except FileNotFoundError as gone:
                raise RuntimeError(f"batch {number} of {self.spool} is gone, but was not read to its end") from gone
            found += sorted((info.path, info.size) for info in batch if info.base_name.endswith(".parquet"))
        return splits(found, self.split) or [Split(())]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.spool)
        wanted = to_arrow_schema(self.schema)
        for path, lo, hi in partition.ranges:
            with files.open_input_file(path) as source:
                table = pq.ParquetFile(source)
                groups = [i for i in range(table.num_row_groups) if lo <= middle(table.metadata.row_group(i)) < hi]
                present = [name for name in wanted.names if name in table.schema_arrow.names]
                for rows in table.iter_batches(ROWS, row_groups=groups, columns=present) if groups else ():
                    yield conformed(rows, wanted)

    def commit(self, end: dict) -> None:
        if not self.delete or end["next"] <= (before := consumed(self.spool)):
            return
        files, folder = opened(self.spool)
        files.create_dir(f"{folder}/_consumed", recursive=True)
        with files.open_output_stream(f"{folder}/_consumed/{end['next']}"):
            pass  # before anything is deleted, so that a restart does not ask for what is gone
        for number in range(before, end["next"]):
            if files.get_file_info(f"{folder}/batch={number}").type != fs.FileType.NotFound:
                files.delete_dir(f"{folder}/batch={number}")
        if before:
            files.delete_file(f"{folder}/_consumed/{before}")


def middle(group: pq.RowGroupMetaData) -> int:
    """The byte in the middle of a row group; the range that holds it reads the group, so exactly one does."""
    columns = [group.column(i) for i in range(group.num_columns)]
    offsets = (c.dictionary_page_offset if c.has_dictionary_page else c.data_page_offset for c in columns)
    return min(offsets) + sum(c.total_compressed_size for c in columns) // 2


def conformed(rows: pa.RecordBatch, wanted: pa.Schema) -> pa.RecordBatch:
    """The wanted columns in their order and types; a column that the file does not have is null."""
    columns = [
        rows.column(field.name).cast(field.type) if field.name in rows.schema.names else pa.nulls(rows.num_rows, field.type)
        for field in wanted
    ]
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


class NotificationSpool(DataSource):
    """``format("notification_spool")``; options ``path``, ``split`` (bytes of a task), ``delete`` (``true`` with a single reader)."""

    @classmethod
    def name(cls) -> str:
        return "notification_spool"

    def schema(self) -> str:
        return "source_id string, ts timestamp, payload string"

    def streamReader(self, schema: T.StructType) -> SpoolReader:
        delete = str(self.options.get("delete", "false")).lower() == "true"
        return SpoolReader(schema, self.options["path"], int(self.options.get("split", SPLIT_BYTES)), delete)


def read_spool(spark: SparkSession, spool: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A stream of the spooled rows. With ``delete="true"`` consumed batches go, which only one stream of a spool may ask for.

    Rows keep whatever columns ``schema`` names, nulls and repeated rows included; other columns of the files are not
    read. An empty or missing spool is a stream without rows yet. A run that ends when all is read (``interval`` unset)
    is one batch of all that is there; after a failure it is the failed batch, and what came since waits for the next run.
    """
    spark.dataSource.register(NotificationSpool)
    return ddl.read_notifications(spark, NotificationSpool.name(), schema, path=spool, **options)
