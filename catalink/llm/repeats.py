"""Removal of byte strings that occur more than once, judged by a cover of positions.

Two equal windows of bytes must share a covered position at the same place. The cover here is locked to content: each window of ``length``
bytes is represented by its anchor, the least hash among its grams of about half that length. Anchors are named by the hash of their gram
and grouped by name; anchors of unique names are discarded, as none of their windows can recur. The names are then extended to all bytes of
the windows an anchor represents: anchors that agree in that too have all these windows in common. Only where names agree and extensions
differ, the windows of an anchor are hashed one by one and grouped. Nothing is sorted into suffix order; the README says why.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import Scratch, text_bytes

BLOCK = 1 << 18  # windows handled at a time
SLICE = 256  # texts handled at a time
PLACE = np.uint64((1 << 19) - 1)
U = np.uint64


def _powers(odd: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK + 4096
    steps = np.full(size, odd, U)
    steps[0] = 1
    back = np.full(size, pow(odd, -1, 1 << 64), U)
    back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


class Rolling:
    """Hashes of any byte strings of a block from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, odd: int, seed: int):
        self.up, self.down = _powers(odd)
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U)

    def sums(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block) + 1, U)
        np.cumsum(self.values[block] * self.up[: len(block)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, length: int) -> np.ndarray:
        return _mixed((sums[length:] - sums[:-length]) * self.down[: len(sums) - length])

    def strings(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, ~U(0), U)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Cover:
    def __init__(self, length: int):
        if not 2 <= length <= 2048:
            raise ValueError("length must be from 2 to 2048 bytes")
        self.length, self.gram = length, max(1, length // 2)
        self.choice = self.length - self.gram + 1  # grams in a window
        self.first, self.second = Rolling(0x9E3779B97F4A7C15, 1), Rolling(0xC2B2AE3D27D4EB4F, 2)

    def blocks(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        whole = np.frombuffer(data, np.uint8)
        for start in range(0, len(data) - self.length + 1, BLOCK):
            yield start, whole[start : start + BLOCK + self.length - 1]

    def anchors(self, data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(name, extension, first window, windows) of the anchors of each block."""
        for base, block in self.blocks(data):
            sums = self.first.sums(block)
            grams = self.first.grams(sums, self.gram)
            keys = (grams & ~PLACE) | np.arange(len(grams), dtype=U)  # the first of equals
            own = (_sliding_least(keys, self.choice) & PLACE).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            count = np.diff(np.concatenate([first, [len(own)]]))
            place = own[first]
            extension = self.second.strings(self.second.sums(block), first, first + count + self.length - 1)
            extension = _mixed(extension + _mixed((place - first).astype(U) * U(0x9E3779B97F4A7C15) + count.astype(U)))
            yield grams[place].view(np.int64), extension.view(np.int64), first + base, count

    def windows(self, data: bytes, first: int, count: int) -> np.ndarray:
        """Hashes of ``count`` consecutive windows."""
        out = []
        for at in range(first, first + count, BLOCK):
            n = min(BLOCK, first + count - at)
            block = np.frombuffer(data, np.uint8, n + self.length - 1, at)
            out.append(self.second.grams(self.second.sums(block), self.length))
        return np.concatenate(out).view(np.int64)


ANCHORS = "name bigint, extension bigint, text_id binary, first bigint, windows bigint"
WINDOWS = "name bigint, window bigint, range bigint, place int"


def _repeat(ids: list[bytes], counts: list[int]) -> pa.Array:
    return pa.array(ids, pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))


def _batch(ids: list[bytes], parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(len(parts[0]))]
    columns.insert(2, _repeat(ids, [len(p[0]) for p in parts]))
    return pa.RecordBatch.from_arrays(columns, names)


def _slices(batches: Iterator[pa.RecordBatch], texts: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, texts):
            yield batch.slice(at, texts)


def text_id(text):
    """The md5 of a text's bytes, by which equal texts are one."""
    return F.unhex(F.md5(text))


def find_repeats(df: DataFrame, length: int) -> DataFrame:
    """(text_id, spans) for each text with repeated windows; spans are [start, end) byte spans that cover all of them, in any order.

    ``df`` has key, text_id and text (binary, not null).
    """
    scratch = Scratch(df.sparkSession)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(length)
        for batch in _slices(batches):
            ids, parts = [], []
            for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for found in cover.anchors(text):
                    ids.append(name)
                    parts.append(found)
            if parts:
                yield _batch(ids, parts, ["name", "extension", "text_id", "first", "windows"])

    anchors = scratch.write(df.select("text_id", "text").mapInArrow(sample, ANCHORS), "anchors")
    # Neighbours with the same name and extension have all windows in common; one of them stands for all.
    alike = anchors.groupBy("name", "extension").agg(F.count("*").alias("copies"), F.min(F.struct("text_id", "first", "windows")).alias("one"))
    alike = scratch.write(alike, "alike")
    names = alike.groupBy("name").agg(F.count("*").alias("extensions"), F.sum("copies").alias("uses")).filter("uses > 1")
    repeated = scratch.write(alike.join(names, "name").select("name", "extension", "copies", "extensions", "one"), "repeated")
    scratch.drop(alike)
    whole = anchors.join(repeated.filter("copies > 1").select("name", "extension"), ["name", "extension"], "left_semi")
    end = F.col("first") + F.col("windows") + (length - 1)
    covered = scratch.write(whole.select("text_id", F.col("first").alias("start"), end.alias("end")).distinct(), "covered")
    scratch.drop(anchors)

    # Where a name has several extensions, the remaining suffixes decide, one for each window.
    ranges = repeated.filter("extensions > 1").select(F.monotonically_increasing_id().alias("range"), "name", "one.*")
    ranges = scratch.write(ranges, "ranges")
    scratch.drop(repeated)
    asked = ranges.groupBy("text_id").agg(F.collect_list(F.struct("range", "name", "first", "windows")).alias("ranges"))
    lowest = df.groupBy("text_id").agg(F.min("key").alias("low"))
    wanted = scratch.write(asked.join(lowest, "text_id"), "wanted")
    rows = df.alias("d").join(wanted.alias("w"), F.expr("d.key <=> w.low AND d.text_id = w.text_id"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(length)
        for batch in _slices(batches, 32):
            parts = []
            for text, asked_ranges in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for r in asked_ranges:
                    hashes = cover.windows(text, r["first"], r["windows"])
                    parts.append((np.full(len(hashes), r["name"]), hashes, np.full(len(hashes), r["range"]), np.arange(len(hashes))))
            columns = [np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i in range(4)]
            kinds = (np.int64, np.int64, np.int64, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], ["name", "window", "range", "place"])

    windows = scratch.write(rows.select("d.text", "w.ranges").mapInArrow(expand, WINDOWS), "windows")
    scratch.drop(wanted)
    # A row that is there several times has its windows several times; they do recur.
    again = windows.groupBy("name", "window").agg(F.count("*").alias("copies")).filter("copies > 1").select("name", "window")
    again = scratch.write(again, "again")
    found = windows.join(again, ["name", "window"], "left_semi").groupBy("range").agg(F.collect_set("place").alias("places"))
    found = scratch.write(found, "found")
    scratch.drop(windows, again)
    single = found.join(ranges, "range").select("text_id", "first", F.explode("places").alias("place"))
    start = F.col("first") + F.col("place")
    single = single.select("text_id", start.alias("start"), (start + length).alias("end")).distinct()
    spans = covered.unionByName(single).groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = scratch.write(spans, "spans")
    scratch.drop(covered, ranges, found)
    return out


def merged(spans: pa.StructArray, text: bytes, whole_characters: bool) -> list[tuple[int, int]]:
    """The maximal runs of the spans' union, ascending; with ``whole_characters`` only the code points that lie wholly inside."""
    starts, ends = np.asarray(spans.field("start")), np.asarray(spans.field("end"))
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]])) if len(starts) else np.zeros(0, int)
    last = np.concatenate([first[1:], [len(starts)]]) - 1 if len(starts) else first
    runs = [[a, b] for a, b in zip(starts[first].tolist(), reach[last].tolist())]
    if whole_characters:
        for run in runs:
            while run[0] < run[1] and run[0] < len(text) and text[run[0]] & 0xC0 == 0x80:
                run[0] += 1
            while run[1] > run[0] and run[1] < len(text) and text[run[1]] & 0xC0 == 0x80:
                run[1] -= 1
    return [(a, b) for a, b in runs if a < b]


PARTS = {
    "n_bytes": "bigint", "removed": "bigint", "n_spans": "bigint", "spans": "array<struct<start: bigint, end: bigint>>", "kept": "binary", "kept_sha256": "string",
}


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, to: str = "repeats", whole_characters: bool = False,
    parts: tuple[str, ...] = ("n_bytes", "removed", "spans", "kept"),
) -> DataFrame:
    """``df`` with a struct column of the asked parts: n_bytes, removed and n_spans long, spans array<struct<start, end>>, kept binary,
    kept_sha256 string (of the kept bytes, lowercase hex).

    Removed is each byte that is covered by a string of ``length`` bytes that also starts anywhere else, in another row or in the same,
    overlapping or not; strings are judged on the input and never cross rows. ``kept`` holds the other bytes. All copies of a repeated
    string go, so equal texts of at least that length lose all bytes. Null texts are empty; shorter texts keep everything; repeated rows,
    null keys, empty tables and extra columns do no harm.

    Strings are equal if two hashes are: the 64 bits of the anchor's gram, half as long, and 64 bits over the whole string. Both are
    polynomials modulo 2**64 over random values of the bytes; no bytes are compared.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    spans = find_repeats(rows.withColumn("text_id", text_id(F.col("text"))), length)

    kinds = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), PARTS["spans"]: pa.list_(kinds)}

    @F.arrow_udf(f"struct<{', '.join(f'{p}: {PARTS[p]}' for p in parts)}>")
    def cut_out(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = {p: [] for p in parts}
        for at in range(0, len(texts), SLICE):
            for data, list_of in zip(text_bytes(texts.slice(at, SLICE)), found.slice(at, SLICE)):
                runs = merged(list_of.values, data, whole_characters) if list_of.is_valid else []
                borders = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2])) if runs else data
                made = {
                    "n_bytes": lambda: len(data), "removed": lambda: len(data) - len(kept), "n_spans": lambda: len(runs), "kept": lambda: kept,
                    "spans": lambda: [{"start": a, "end": b} for a, b in runs], "kept_sha256": lambda: sha256(kept).hexdigest(),
                }
                for p in parts:
                    out[p].append(made[p]())
        return pa.StructArray.from_arrays([pa.array(out[p], kinds[PARTS[p]]) for p in parts], list(parts))

    own, there = "__own_text_id", "__text_id"
    tagged = df.withColumn(own, text_id(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    spans = spans.select(F.col("text_id").alias(there), F.col("spans").alias("__spans"))
    joined = tagged.join(spans, F.col(own) == F.col(there), "left")
    return joined.withColumn(to, cut_out(F.col(text), F.col("__spans"))).drop(own, there, "__spans")
