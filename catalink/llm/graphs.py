"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component; nodes are of any ordered type.

    Alternating large-star and small-star rounds. A node's least neighbour is a partial aggregate, and neighbours meet it in a join,
    which adaptive execution splits for hub nodes. Each round is a table of ``scratch``. Self loops and repeated edges do no harm.
    """

    def digest(stars: DataFrame):
        return stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    stars = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    stars = scratch.write(stars, "stars")
    before = None
    while (now := digest(stars)) != before:
        before = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = scratch.write(large.filter("a <> b").distinct(), "stars")  # every a is larger than its b
        scratch.drop(stars)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        stars = scratch.write(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "stars")
        scratch.drop(large)
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
