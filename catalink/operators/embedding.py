"""Embedding jobs: batches of texts in, vectors out, with the same checks whichever embedder is plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalink.functions.text import is_blank, tokens

DIMENSION = 64
BATCH_SIZE = 50
SLICE = 512  # rows whose tokens are counted at a time

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

VECTOR = T.ArrayType(T.FloatType())


def token_buckets(words: Sequence[str], dim: int) -> np.ndarray:
    """Bucket of each token: the first 32 bits of its MD5 modulo ``dim``."""
    heads = (int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dim for w in words)
    return np.fromiter(heads, dtype=np.int64, count=len(words))


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = DIMENSION) -> DataFrame:
    """The default embedder: L2-normalised term counts over ``dim`` hashed buckets.

    Spark cuts the tokens; within each slice of an Arrow batch every distinct token is hashed once and all rows are counted
    with one bincount. Blank texts get an empty vector, which the quality gate reports.
    """
    keep = df.columns
    cut_up = df.withColumn("__tokens", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    schema = T.StructType([*df.schema.fields, T.StructField(out, VECTOR)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            cells = batch.column(batch.schema.get_field_index("__tokens"))
            lengths = np.diff(cells.offsets.to_numpy())
            encoded = cells.flatten().dictionary_encode()
            buckets = token_buckets(encoded.dictionary.to_pylist(), dim)[encoded.indices.to_numpy(zero_copy_only=False)]
            rows = np.repeat(np.arange(len(lengths)), lengths)
            matrix = np.bincount(rows * dim + buckets, minlength=len(lengths) * dim).reshape(-1, dim).astype(np.float64)
            filled = lengths > 0
            matrix[filled] /= np.linalg.norm(matrix[filled], axis=1, keepdims=True)
            offsets = np.concatenate([[0], np.cumsum(np.where(filled, dim, 0))]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix[filled].astype(np.float32).ravel()))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, vectors], names=[*keep, out])

    return cut_up.mapInArrow(count, schema)


def embed(
    df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding", batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Vectors for every row, in order, at most ``batch_size`` texts per call of ``embedder``.

    The job fails when a call returns another number of vectors than texts, or an empty vector.
    """
    if embedder is None:
        return hashed_embedding(df, text, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, VECTOR)])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                vectors = embedder(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"embedder returned {len(vectors)} vectors for {len(texts)} texts")
                if any(v is None or len(v) == 0 for v in vectors):
                    raise ValueError("embedder returned an empty vector")
                column = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return df.mapInArrow(call, schema)


def split_blank(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with text, and rows whose text is missing or blank."""
    return df.filter(~is_blank(F.col(text))), df.filter(is_blank(F.col(text)))


def embed_questions(
    questions: DataFrame, embedder: Embedder | None = None, text: str = "question"
) -> tuple[DataFrame, DataFrame]:
    """Questions with their vectors in the documents' space, and the rejected blank ones."""
    asked, blank = split_blank(questions, text)
    return embed(asked, text, embedder), blank.withColumn("error", F.lit("question is blank"))


def embedding_gate(units: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Units, and units without a usable vector, per key."""
    missing = F.col(vector).isNull() | (F.size(vector) == 0)
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(missing).alias("missing"), (F.count_if(missing) == 0).alias("complete")
    )
