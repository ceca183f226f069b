"""Audit roll-ups that can be merged: one row per day and group, any span of days without the log.

Counts and sums add up. Distinct statements and tables are theta sketches, score quantiles KLL sketches; both merge without
the rows behind them. A sketch of few values is as small as these, and none grows beyond a fixed size (32 KB for
``THETA_BITS``), however many statements it stands for.

Error bounds, whatever was merged: distinct counts below ``2 ** THETA_BITS`` are exact, others within ``DISTINCT_ERROR``
(five standard errors); the rank of a quantile is within ``RANK_ERROR`` (twice the 99 % bound of a KLL sketch with ``KLL_K``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from catalink.session import cut

THETA_BITS = 12
KLL_K = 800
DISTINCT_ERROR = 5 / 2 ** (THETA_BITS / 2)
RANK_ERROR = 0.008
GROUP = ("dialect", "complexity")


def hashed(text: Column) -> Column:
    """A number for a text, null for null. The sketches would leave out empty texts, and long ones would travel with their row."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def daily(audited: DataFrame, day: str = "day", *group: str) -> DataFrame:
    """One row per ``day`` and group of audited statements (``audit.audit`` with a date column).

    Statements are told apart by a 64-bit hash of their text. A statement without text, score or tables counts as a statement and adds
    nothing to that sketch. A null day or group is a day or group of its own. Partial sketches are built before the
    shuffle, so a day or dialect with a third of all rows is a few sketches per task.
    """
    group = group or GROUP
    table = F.struct(F.lit(0).alias("one"), F.lit(0).alias("passed"), F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("bigint").alias("statement"))
    own = F.struct(
        F.lit(1).alias("one"), F.when(F.col("passed"), 1).otherwise(0).alias("passed"), F.col("overall_score").cast("bigint").alias("score"),
        hashed(F.col("sql")).alias("statement"),
    )
    # One row for the statement itself and one for each of its tables, so that a single aggregation builds all sketches.
    names = F.array_distinct(F.coalesce("referenced_tables", F.array().cast("array<string>")))
    facts = F.concat(
        F.array(own.withField("table_hash", F.lit(None).cast("bigint"))), F.transform(names, lambda name: table.withField("table_hash", hashed(name)))
    )
    return (
        audited.select(day, *group, F.inline(facts))
        .groupBy(day, *group)
        .agg(
            F.sum("one").alias("queries"), F.sum("passed").alias("passed"), F.sum("score").alias("score_sum"), F.count("score").alias("scored"),
            F.theta_sketch_agg("statement", F.lit(THETA_BITS)).alias("statement_sketch"), F.theta_sketch_agg("table_hash", F.lit(THETA_BITS)).alias("table_sketch"),
            F.kll_sketch_agg_bigint("score", F.lit(KLL_K)).alias("score_sketch"),
        )
    )


def merge(rolled: DataFrame, *keys: str | Column) -> DataFrame:
    """Roll-up rows put together by ``keys``; without keys a single row. The result can be merged again."""
    return rolled.groupBy(*keys).agg(
        *(F.sum(name).alias(name) for name in ("queries", "passed", "score_sum", "scored")),
        F.theta_union_agg("statement_sketch", F.lit(THETA_BITS)).alias("statement_sketch"), F.theta_union_agg("table_sketch", F.lit(THETA_BITS)).alias("table_sketch"),
        F.kll_merge_agg_bigint("score_sketch", F.lit(KLL_K)).alias("score_sketch"),
    )


def summary(rolled: DataFrame, *keys: str, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """What the sketches say: pass rate, mean score, distinct statements and tables, ``quantiles`` of the scores (null without one)."""
    wanted = F.array(*(F.lit(float(q)) for q in quantiles))
    return rolled.select(
        *keys, "queries", "passed", (F.col("passed") / F.col("queries")).alias("pass_rate"),
        F.when(F.col("scored") > 0, F.col("score_sum") / F.col("scored")).alias("mean_score"),
        F.theta_sketch_estimate("statement_sketch").alias("statements"), F.theta_sketch_estimate("table_sketch").alias("tables"),
        F.when(F.col("scored") > 0, F.kll_sketch_get_quantile_bigint("score_sketch", wanted)).alias("score_quantiles"),
    )


def write(rolled: DataFrame, path: str, day: str = "day") -> None:
    """Keep daily rows in a folder per month. Days that ``rolled`` has are replaced, so a day can be rolled up again; others stay.

    The months touched are rewritten through dynamic partition overwrite, which swaps the new files in when the job
    commits. Null days are a month of their own.
    """
    spark, month = rolled.sparkSession, F.date_format(day, "yyyy-MM")
    fresh = rolled.withColumn("month", month)
    try:
        stored = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException:
        stored = None
    if stored is not None:
        # Days and months are broadcast: a calendar has a few hundred of them a year, whatever the log holds.
        days = cut(rolled.select(F.col(day).alias("fresh_day")).distinct(), "days")
        months = days.select(F.date_format("fresh_day", "yyyy-MM").alias("fresh_month")).distinct()
        others = stored.join(F.broadcast(months), F.col("month").eqNullSafe(F.col("fresh_month")), "left_semi").join(
            F.broadcast(days), F.col(day).eqNullSafe(F.col("fresh_day")), "left_anti"
        )
        fresh = fresh.unionByName(others)
    fresh.repartition("month").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def span(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, day: str = "day") -> DataFrame:
    """The kept rows from ``first`` to ``last`` (``yyyy-MM-dd``), both included; only the folders of their months are opened."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter((F.col("month") >= first[:7]) & (F.col(day) >= F.lit(first).cast("date")))
    if last is not None:
        rows = rows.filter((F.col("month") <= last[:7]) & (F.col(day) <= F.lit(last).cast("date")))
    return rows.drop("month")
