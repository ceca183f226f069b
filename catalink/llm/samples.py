"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows (all, if fewer), chosen by a hash of the key columns: the same rows on every run, in any partitioning.

    Rows that agree in all keys are taken or left together. Null keys take part. Costs a count over the keys.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(GRAIN)) < F.lit(max(1, GRAIN * rows // total)))
