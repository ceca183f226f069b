import hashlib

import pytest

from catalink.llm import fingerprints as fp
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


def brute(rows):
    """Results by key for (key, text) rows with distinct keys."""
    rows = sorted((k, t or "") for k, t in rows)
    out = {}
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (fp.digest(x.encode()) for x in (text, edited, following))
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, fp.likenesses([own], [other])[0], fp.likenesses([own], [after])[0])
    return out


def found(df):
    return {r["doc_id"]: tuple(r)[1:] for r in fp.fingerprint_edits(df).collect()}


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_every_row_meets_its_successor(spark, parts):
    texts = ["", None, "a", "ab", "día 😀 ñ", "x" * 3000, "the end of it " * 40, "the end of it " * 41, "漢字" * 50]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = docs(spark, texts, ids=[50, 3, 9, 100, 7, 8, -4, 20, 21])
        assert found(clashing(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_documents_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = found(df)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    closer = sum(r[4] >= r[5] for r in got.values())
    assert closer > 0.8 * len(got)  # half the same text is nearer than another text


def test_one_row_is_its_own_successor_and_no_row_is_none(spark):
    assert found(docs(spark, ["abcd"]))[0][1] == hashlib.sha256(b"abab").hexdigest()
    assert found(docs(spark, [])) == {}


def test_repeated_keys_and_null_keys_stay(spark):
    df = docs(spark, ["one text", "one text", "other", "third"], ids=[1, 1, 1, None])
    assert fp.fingerprint_edits(df).count() == 4


def test_likeness_is_bounded_and_symmetric():
    texts = [b"", b"a", b"abc" * 10, b"the quick brown fox " * 30, bytes(range(256)) * 4]
    for a in texts:
        for b in texts:
            x, y = fp.digest(a), fp.digest(b)
            assert fp.likenesses([x], [y]) == fp.likenesses([y], [x])
            assert 0 <= fp.likenesses([x], [y])[0] <= 1
            assert (x == y) == (a == b) or len(a) < 3
        assert fp.likenesses([fp.digest(a)], [fp.digest(a)])[0] == 1


def test_a_small_edit_moves_little():
    text = " ".join(f"word{i * i % 97}" for i in range(400))
    edited = text.replace("word9 ", "ward9 ")
    other = " ".join(f"{i * 7919 % 1000}" for i in range(400))
    own = fp.digest(text.encode())
    assert fp.likenesses([own], [fp.digest(edited.encode())])[0] > 0.9 > fp.likenesses([own], [fp.digest(other.encode())])[0]
