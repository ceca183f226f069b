"""The registered queries of the corpus operators, with production parameters, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm import (
    chat, fingerprints, language, licences, mixing, near_duplicates, neighbours, quality, repeats, sentencepiece_codec, spelling, url_filters,
    vector_codes,
)
from catalink.llm.common import fold, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mix(docs.select("doc_id", "source", "size"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("fold", fold(F.col("doc_id"), 3))
    model = language.fit(docs.filter("fold != 1"))  # a null id is in no fold and is not learned from
    found = language.predict(docs.select("doc_id", "fold", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    parts = ("n_ids", "ids_sha256", "decoded_sha256", "n_bytes")
    encoded = sentencepiece_codec.encode_texts(docs, model, parts=parts)
    return encoded.select("doc_id", F.col("encoding.n_ids").alias("n_tokens"), *[f"encoding.{p}" for p in parts[1:]])


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("n_bytes", "removed", "n_spans", "kept_sha256")
    found = repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), parts=parts)
    return found.select("doc_id", "repeats.n_bytes", F.col("repeats.removed").alias("n_removed"), "repeats.n_spans", "repeats.kept_sha256")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates.near_duplicates(docs, shingle_words=3, percent=85)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.PASS_MARK).cast("int").alias("predicted"),
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0").select("vec_id"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    out = vector_codes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books.sha256))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")


# Texts that look like the marks of a template.
SPOOFED = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    spoofed = spark.createDataFrame(SPOOFED, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(spoofed)))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_fingerprints": op4_fingerprints,
    "op5_repeats": op5_repeats,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_licences": op7_licences,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_url_filters": op10_url_filters,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat": op13_chat,
}
ORACLES = {"op7_licences": licences.oracle(), "op13_chat": chat.ORACLE}
