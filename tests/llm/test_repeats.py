import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.llm import repeats
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


def brute(texts, length):
    """[(n_bytes, removed, spans, kept)] by looking every string up."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (at := covered.find(1, at)) >= 0:
            end = covered.find(0, at)
            end = len(d) if end < 0 else end
            spans.append((at, end))
            at = end
        out.append((len(d), sum(covered), spans, bytes(b for b, c in zip(d, covered) if not c)))
    return out


def found(df, **parameters):
    got = repeats.remove_repeats(df, **parameters).select("doc_id", "repeats.*").orderBy("doc_id").collect()
    return [(r["n_bytes"], r["removed"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got]


def prose(draw, n):
    return " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("length", [2, 5, 20, 33, 200])
def test_repeats_equal_brute_force(spark, length):
    draw = random.Random(length)
    shared = [prose(draw, draw.randint(1, length)) for _ in range(6)]
    texts = [None, "", "a", "ab" * length, "x" * (3 * length), "x" * length, "x" * (length - 1)]
    for _ in range(40):
        parts = [prose(draw, draw.randint(0, length // 2))]
        for _ in range(draw.randint(0, 4)):
            passage = draw.choice(shared)
            cut = draw.randint(0, len(passage) // 3)
            parts += [passage[cut : len(passage) - draw.randint(0, len(passage) // 3)], prose(draw, draw.randint(0, length // 2))]
        texts.append(draw.choice(["", " ", "é"]).join(parts))
    texts += texts[10:14]
    df = docs(spark, texts)
    assert found(clashing(df), length=length) == brute(texts, length)


def test_one_byte_more_or_less(spark):
    draw = random.Random(1)
    for common in (199, 200, 201):
        passage = "".join(draw.choice("abcdefgh") for _ in range(common))
        texts = ["1" * 150 + passage + "2" * 150, "3" * 120 + passage + "4" * 170, passage[:100]]
        got = found(docs(spark, texts))
        assert [g[1] for g in got] == ([0, 0, 0] if common < 200 else [common, common, 0])


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    draw = random.Random(4)
    texts = [prose(draw, 900) for _ in range(4)]
    texts.append(texts[0][500:2500] + texts[1][100:1900])
    want = brute(texts, 200)
    for size in (37, 1000):
        monkeypatch.setattr(repeats, "BLOCK", size)
        monkeypatch.setattr(repeats, "_powers", repeats._powers)
        found_names = []
        for text in texts:
            cover = repeats.Cover(200)
            count = sum(int(c.sum()) for _, _, _, c in cover.anchors(text.encode()))
            found_names.append(count)
        assert found_names == [max(0, len(t.encode()) - 199) for t in texts]
    assert found(docs(spark, texts)) == want


def test_equal_windows_have_equal_anchors():
    draw = random.Random(8)
    passage = prose(draw, 200).encode()
    cover = repeats.Cover(50)

    def anchors(data):
        out = []
        for name, _, first, count in cover.anchors(data):
            out += [n for n, c in zip(name.tolist(), count.tolist()) for _ in range(c)]
        return out

    whole, moved = anchors(passage), anchors(b"before " * 9 + passage[30:] + b" after")
    inner = len(passage) - 30 - 50 + 1
    assert whole[30 : 30 + inner] == moved[63 : 63 + inner]


def test_very_long_and_periodic_texts(spark):
    draw = random.Random(6)
    long = prose(draw, 120_000)
    texts = [long, "start " + long[200_000:300_000] + " end", "ab " * 100_000]
    got = found(docs(spark, texts))
    # The spaces around the passage also stand around it in the long text or not; its own bytes do in any case.
    assert 100_000 <= got[1][1] <= 100_010 and got[0][1] == got[1][1] and got[2][1] == 300_000


def test_whole_characters(spark):
    texts = ["aé" + "日本" * 60 + "x", "bé" + "日本" * 60 + "y", "ü" * 300]
    got = repeats.remove_repeats(docs(spark, texts), whole_characters=True).select(F.col("repeats.kept").cast("string").alias("t"), "doc_id")
    kept = {r["doc_id"]: r["t"] for r in got.collect()}
    assert kept == {0: "ax", 1: "by", 2: ""}


def test_empty_table_and_repeated_keys(spark):
    assert found(docs(spark, [])) == []
    text = prose(random.Random(3), 100)
    df = docs(spark, [text, text, "short", "short"], ids=[1, 1, None, None])
    got = repeats.remove_repeats(df).select("doc_id", "repeats.removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, len(text)), (1, len(text)), (None, 0), (None, 0)], key=repr)


def test_documents_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    assert found(df) == brute(texts, 200)


def test_sliding_least():
    draw = np.random.default_rng(1)
    for n, width in ((1, 1), (7, 3), (20, 20), (50, 7)):
        keys = draw.integers(0, 99, n).astype(np.uint64)
        assert repeats._sliding_least(keys, width).tolist() == [keys[i : i + width].min() for i in range(n - width + 1)]
