"""Small helpers of the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.session import scratch_path

WORDS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key's decimal text modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def text_bytes(values) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string or binary array; a null is empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator in the shared folder: written once, read by later steps, dropped when they are not needed any more.

    They cut the lineage and survive lost executors. The shuffle files of a written step are given back at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path, table
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables, or all that are left if none is named."""
        for name in [id(t) for t in tables] if tables else list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name)[0])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
