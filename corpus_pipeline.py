"""From raw documents to training tokens: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalink.llm import mixing, near_duplicates, quality, repeats, sentencepiece_codec
from catalink.llm.common import read
from catalink.session import cut

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from ``labels.quality``, reaches the threshold; without labels of both kinds, all."""
    model = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), model, to="__score").filter(F.col("__score") >= quality.PASS_MARK).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest doc_id, then the least text hash.

    Rows with one doc_id and one text are one document; rows with one doc_id and several texts are several. Of repeated rows one stays.
    Rows without doc_id come last and are told apart by their text. Null, empty and blank texts are like nothing but their own repetition.
    """
    light = docs.select("doc_id", F.xxhash64("text").alias("__text"))
    mixed = light.groupBy("doc_id").agg((F.min("__text") < F.max("__text")).alias("__mixed")).filter("__mixed AND doc_id IS NOT NULL")
    own = F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit("document"), "doc_id", "text"), F.lit(1 << 61))
    docs = docs.select(*COLUMNS).join(mixed, "doc_id", "left")  # few, if any
    docs = docs.withColumn("__key", F.when(F.col("__mixed") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id"))).drop("__mixed")
    groups = near_duplicates.near_duplicates(docs, "__key").select("__key", "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"))
    first = docs.select("__key", rank.alias("rank")).join(groups, "__key").groupBy("component_id").agg(F.min_by("__key", "rank").alias("__kept"))
    rows = docs.join(first.select("__kept"), F.col("__key") == F.col("__kept"))
    place = F.row_number().over(Window.partitionBy("__kept").orderBy("source", "lang"))
    return rows.withColumn("__place", place).filter("__place = 1").select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the characters in 200-byte strings that also start elsewhere; n_chars counts what is left."""
    found = repeats.remove_repeats(docs.select(*COLUMNS), to="__found", whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("__found.kept").cast("string"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it: not at all, once or twice."""
    return mixing.take(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and digests of ids and decoded text."""
    parts = ("ids", "n_ids", "ids_sha256", "decoded_sha256")
    encoded = sentencepiece_codec.encode_texts(docs.select(*COLUMNS), MODEL, parts=parts, to="__e")
    return encoded.select(
        "doc_id", "lang", "source", F.col("__e.n_ids").alias("n_tokens"), "__e.ids", "__e.ids_sha256", "__e.decoded_sha256"
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", tokens),
]

# A fitted ranking, rounding by hashes and tokens have no DuckDB twin; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
