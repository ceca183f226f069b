"""Spelling variant grouping by PartEnum signatures.

A word's letter multiset is a binary vector with one dimension for each letter and count (first e, second e, ...). One inserted, deleted or
replaced letter changes at most two dimensions. The dimensions are dealt into PARTS parts; two vectors at a Hamming distance of at most
two agree in all parts but two, so they share at least one of the signatures that leave two parts out. Equal signatures are joined, and the
edit distance verifies.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import Scratch, text_bytes

DISTANCE = 2
PARTS = 7
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")  # of UTF-8 with A-Z lowered: letters up to U+00FF
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")  # in no run
SLICE = 1 << 20  # bytes of a text that are searched at a time
HELD = 200_000  # words that a task counts before it hands them on


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes that cut no run."""
    at = 0
    while len(text) - at > SLICE:
        cut = BREAK.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def counted_words(df: DataFrame, key: str, text: str, one_in: int, least_chars: int, least_count: int) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, after the slip of the pen that ``variant_groups`` describes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for own, whole in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                start = zlib.crc32(f"{'' if own is None else own}:".encode())  # goes on with the word: the digest of both
                for piece in _slices(whole):
                    for word, n in Counter(RUN.findall(piece.lower())).items():  # of bytes: only A-Z change
                        if len(word) < least_chars:
                            continue
                        h = zlib.crc32(word, start)
                        if h % one_in == 0 or not word.isascii():
                            letters = word.decode()
                            if h % one_in == 0:
                                at = h % len(letters)
                                letters = letters[:at] + letters[at + 1 :]
                                word = letters.encode()
                            if len(letters) < least_chars:
                                continue
                        held[word] += n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        yield out()

    rows = df.select(F.col(key).cast("string"), F.col(text).cast("binary"))
    counts = rows.mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def signatures(word: str) -> list[int]:
    """One signature for each choice of parts to leave out: a digest of the choice and the word's dimensions in the other parts."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for letter, times in sorted(Counter(word).items()):
        for i in range(times):
            name = f"{letter}{i},"
            parts[xxhash.xxh3_64_intdigest(name) % PARTS].append(name)
    joined = ["".join(p) for p in parts]
    out = []
    for left_out in combinations(range(PARTS), DISTANCE):
        seen = ";".join(p for i, p in enumerate(joined) if i not in left_out)
        out.append(xxhash.xxh3_64_intdigest(f"{left_out}{seen}") - (1 << 63))
    return out


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: the pairs of words that differ by exactly one inserted, deleted or replaced code point.

    The join verifies while it joins, so candidates are no rows; adaptive execution splits the words of a frequent signature.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            lists = pa.array([signatures(w) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), lists], ["word", "signatures"])

    signed = words.select("word").mapInArrow(sign, "word string, signatures array<bigint>")
    signed = signed.select("word", F.length("word").alias("chars"), F.explode("signatures").alias("signature"))
    signed = scratch.write(signed, "signatures")
    a = signed.select(F.col("word").alias("a"), F.col("chars").alias("a_chars"), "signature")
    b = signed.select(F.col("word").alias("b"), F.col("chars").alias("b_chars"), "signature")
    near = (F.abs(F.col("a_chars") - F.col("b_chars")) <= 1) & (F.col("a") < F.col("b"))
    pairs = a.join(b, (a["signature"] == b["signature"]) & near & (F.levenshtein("a", "b", 1) == 1))
    pairs = scratch.write(pairs.select("a", "b").distinct(), "near")
    scratch.drop(signed)
    return pairs


def variant_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 6, least_count: int = 5, times: int = 5, one_in: int = 199
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, of which only A-Z are lowered. With h the crc32 of ``<key>:<run>``, a run whose h
    is divisible by ``one_in`` loses its code point h % length. Results of at least ``least_chars`` code points that occur at least
    ``least_count`` times (n) are words. ``form`` is the near word (see ``near_words``) of largest n, the smallest of equals in code point
    order, if that n is at least ``times`` the word's; else null. ``root`` is the end of the forms from the word on, the word itself if it
    has none. ``n_near`` counts the near words.

    Null texts have no words, a null key counts as empty, repeated rows count each time, texts of any length are read whole. A table
    without words gives an empty result; extra columns are ignored. A form occurs more often than its word, so forms never run in
    circles, and following them doubles the reach in each round. Words are counted in the tasks first; no group but a signature's is ever
    together, and that is joined by parts.
    """
    scratch = Scratch(df.sparkSession)
    words = scratch.write(counted_words(df, key, text, one_in, least_chars, least_count), "words")
    pairs = near_words(words, scratch)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rated = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = rated.groupBy("a").agg(F.min(F.struct((-F.col("b_n")).alias("rank"), "b")).alias("best"), F.count("*").alias("n_near"))
    formed = words.join(best, words["word"] == best["a"], "left")
    large = -F.col("best.rank") >= times * F.col("n")
    formed = scratch.write(formed.select(
        "word", F.when(large, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, -F.col("best.rank")).alias("form_n"),
    ), "forms")
    scratch.drop(words, pairs)

    reach = scratch.write(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = scratch.write(longer, "roots")
        scratch.drop(reach)
        reach = longer
        if reach.filter("moved").isEmpty():
            break
    out = formed.join(reach.select("word", "root"), "word", "left")
    out = scratch.write(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.drop(formed, reach)
    return out
