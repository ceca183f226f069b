"""Ranking helpers: every top-k is a row_number window that Catalyst turns into a partial group limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. A literal ``k`` lets the plan drop rows before the shuffle (WindowGroupLimit)."""
    return ranked(df, keys, order, rank).filter(F.col(rank) <= k)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__first").drop("__first")
