"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without time zone, the latter taken as it is written."""
    plain = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    start = "TIMESTAMP_NTZ'1970-01-01 00:00:00'" if plain else "TIMESTAMP'1970-01-01 00:00:00Z'"
    gap = F.col(column) - F.expr(start)
    part = lambda field: F.extract(F.lit(field), gap).cast("long")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + F.floor(F.extract(F.lit("SECOND"), gap)).cast("long")
