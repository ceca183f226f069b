"""Fingerprints of documents: quartile digests of hashed byte-triplet counts, compared by a bounded difference score.

Every window of five bytes gives six triplets, each hashed into one of 128 buckets. The digest holds a logarithmic length code, two
quartile ratios and, for each bucket, the quartile its count falls in. Small edits move few buckets over a quartile.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalink.llm.common import text_bytes
from catalink.session import cut

BUCKETS = 128
TRIPLETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]  # places of the second and third byte after the first
BOUND = 300.0  # differences from here on count as no likeness at all
LENGTH_STEPS = 8  # length codes per doubling


def digest(data: bytes) -> str:
    """68 hex digits: length code (2), quartile ratios (1 + 1), two bits for each bucket (64). Depends on the bytes only."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    first, second, third = x * np.uint32(0x9E3779B1), x * np.uint32(0x85EBCA77), x * np.uint32(0xC2B2AE3D)
    found = []
    for kind, (b, c) in enumerate(TRIPLETS):
        n = len(x) - c
        if n <= 0:
            continue
        h = first[:n] + second[b : b + n]
        h += third[c : c + n]
        h += np.uint32(0x27D4EB2F * (kind + 1) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(25)
        found.append(h)
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]].tolist()
    codes = ((counts > q1).view(np.uint8) + (counts > q2).view(np.uint8) + (counts > q3).view(np.uint8)).reshape(-1, 4)
    body = (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8).tobytes().hex()
    length = min(255, int(LENGTH_STEPS * math.log2(len(data) + 1)))
    top = max(q3, 1)
    return f"{length:02x}{15 * q1 // top:x}{15 * q2 // top:x}{body}"


def _parts(digests: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)
    body = raw[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    ratios = np.stack([raw[:, 1] >> 4, raw[:, 1] & 15], 1)
    return raw[:, 0].astype(np.int64), ratios.astype(np.int64), body.reshape(len(digests), -1).astype(np.int64)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, falling with the difference score to 0 at BOUND.

    A bucket adds the distance of its quartiles, 6 for opposite ends; a length code adds its distance over LENGTH_STEPS / 4, a ratio its own.
    """
    if not a:
        return np.zeros(0)
    (la, ra, ba), (lb, rb, bb) = _parts(a), _parts(b)
    gap = np.abs(ba - bb)
    score = (gap + 3 * (gap == 3)).sum(1) + np.abs(la - lb) * 4 / LENGTH_STEPS + np.abs(ra - rb).sum(1)
    return 1.0 - np.minimum(score, BOUND) / BOUND


@F.arrow_udf(T.StringType())
def _digest_udf(texts: pa.Array) -> pa.Array:
    return pa.array([digest(t) for t in text_bytes(texts)], pa.string())


@F.arrow_udf(T.DoubleType())
def _likeness_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    both = [x is not None and y is not None for x, y in zip(a.to_pylist(), b.to_pylist())]
    found = iter(likenesses([x for x, ok in zip(a.to_pylist(), both) if ok], [y for y, ok in zip(b.to_pylist(), both) if ok]).tolist())
    return pa.array([next(found) if ok else None for ok in both], pa.float64())


def fingerprint(text: Column) -> Column:
    """The digest of a text's UTF-8 bytes, whatever its length; null counts as empty."""
    return _digest_udf(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two digests, 0 to 1; null if either is null."""
    return _likeness_udf(a, b)


# ---- each document beside its successor ----------------------------------------------------------------------------------

RESULT = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
])
EDGE = T.StructType([
    *RESULT.fields,
    T.StructField("part", T.IntegerType()),
    T.StructField("edge", T.StringType()),
    T.StructField("text", T.BinaryType()),
])


def _compared(rows: list[tuple], following: list[tuple]) -> list[tuple]:
    """RESULT rows of (key, text, digest) beside their successors."""
    out = []
    for (key, text, own), (_, next_text, _) in zip(rows, following):
        shown = text.decode("utf-8", "replace")
        half = len(shown) // 2
        # The first ``half`` code points are within the first 4 * half bytes.
        edited = shown[: len(shown) - half] + next_text[: 4 * half].decode("utf-8", "replace")[:half]
        raw = edited.encode()
        out.append((key, len(shown), hashlib.sha256(raw).hexdigest(), own, digest(raw)))
    near = likenesses([r[3] for r in out], [r[4] for r in out]).tolist()
    after = likenesses([r[3] for r in out], [f[2] for f in following]).tolist()
    return [(*r, a, b) for r, a, b in zip(out, near, after)]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition's rows but its last, which is an edge row with its text, as the first is."""
    part, last = TaskContext.get().partitionId(), None
    blank = (None,) * (len(RESULT) - 2)
    for batch in batches:
        rows = [(k, t, digest(t)) for k, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)))]
        if not rows:
            continue
        edges = [] if last else [(rows[0][0], None, None, rows[0][2], None, None, None, part, "first", rows[0][1])]
        chain = [last, *rows] if last else rows
        yield _batch([(*r, part, None, None) for r in _compared(chain[:-1], chain[1:])] + edges, EDGE)
        last = chain[-1]
    if last:
        yield _batch([(last[0], None, None, last[2], *blank[:3], part, "last", last[1])], EDGE)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, text, own, next_text, next_own = (c.to_pylist() for c in batch.columns)
        yield _batch(_compared(list(zip(key, text, own)), [(None, t, f) for t, f in zip(next_text, next_own)]), RESULT)


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms: one row per row, columns of RESULT with ``key`` under its own name.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row's, in ascending order
    of the key, after the last the first. Null keys come first; rows of one key follow each other by a hash of their text, then the text,
    so that repeated rows have one result. Null texts are empty. An empty table gives an empty result; extra columns are ignored.

    Texts are shuffled once, into ranges of keys. Tasks stream their range; only a range's first and last row, whose neighbours lie in
    other ranges, are joined afterwards, from a table written once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    written = cut(ranges.mapInArrow(_stream, EDGE), "fingerprints")
    firsts, lasts = written.filter("edge = 'first'"), written.filter("edge = 'last'")
    order = Window.orderBy("part")  # one small number per partition
    lowest = F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = firsts.select("part", F.coalesce(F.lead("part").over(order), lowest).alias("next_part"))
    following = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    edges = lasts.join(steps, "part").join(following, "next_part").select("key", "text", "fingerprint", "next_text", "next_own")
    done = written.filter(F.col("edge").isNull()).select(*RESULT.names)
    return done.unionByName(edges.mapInArrow(_edges, RESULT)).withColumnRenamed("key", key)
