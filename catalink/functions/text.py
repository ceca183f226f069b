"""Text expressions: tokens, document fragments, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word pieces of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def tree_digest(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    digest: str,
    bits: int = 256,
    hashed_items: bool = False,
) -> DataFrame:
    """Order-free digest of all ``item`` strings per key, in two levels.

    Items are hashed, spread over 4,096 buckets by the head of their hash, and each bucket is digested on its own;
    the key's digest covers at most 4,096 bucket digests. No task ever holds all items of a large key, however
    unevenly the items are spread over the keys. Duplicated items count. With ``hashed_items`` the items are hashes already.
    """

    def hashed(value: Column) -> Column:
        return F.md5(value.cast("binary")) if bits == 128 else F.sha2(value.cast("binary"), bits)

    leaf = df.select(*keys, (F.col(item) if hashed_items else hashed(F.col(item))).alias("__h"))
    counted = leaf.groupBy(*keys, "__h").agg(F.concat_ws(":", "__h", F.count(F.lit(1)).cast("string")).alias("__i"))
    buckets = (
        counted.withColumn("__b", F.substring("__h", 1, 3))
        .groupBy(*keys, "__b")
        .agg(hashed(F.array_join(F.array_sort(F.collect_list("__i")), ",")).alias("__d"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__d"))), lambda s: s["__d"]), ",")
    return buckets.groupBy(*keys).agg(hashed(joined).alias(digest))
