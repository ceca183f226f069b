import itertools
import random

import pytest

from catalink.llm.common import Scratch
from catalink.llm.graphs import components
from catalink.llm.near_duplicates import least_overlap, near_duplicates
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(min(width, len(words)))))) if words else frozenset()


def brute(rows, width, percent):
    """{(key, text): (n, component)} by comparing everything with everything."""
    sets = [(k, t, shingles(t, width)) for k, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        common = len(a[2] & b[2])
        if common and 100 * common >= percent * len(a[2] | b[2]):
            root[find(i)] = find(j)
    low = {}
    for i, (k, _, _) in enumerate(sets):
        low.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _, s) in enumerate(sets):
        ids = [x for x in low[find(i)] if x is not None]
        component = k if not s else min(ids) if ids else None
        out.append((k, len(s), component, component == k))
    return sorted(out, key=repr)


def found(df, **parameters):
    return sorted((tuple(r) for r in near_duplicates(df, **parameters).collect()), key=repr)


def family(draw, words, copies, edits):
    base = [draw.choice(words) for _ in range(draw.randint(30, 200))]
    out = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_families_equal_brute_force(spark, width, percent):
    draw = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(12) for t in family(draw, words, 8, 9)]
    line = "this line is in very many of the documents and says nothing at all "
    texts += [line * 3 + " ".join(draw.choice(words) for _ in range(n)) for n in (0, 1, 2, 5, 10, 20, 40)]
    texts += ["", None, "  \n", "a", "A", "a b", "B a", "x y z", "X Y Z", "ÀB c d", "àB c d", "one two three four five six"]
    df = docs(spark, texts)
    assert found(clashing(df), shingle_words=width, percent=percent) == brute([(r["doc_id"], r["text"]) for r in df.collect()], width, percent)


def test_chains_and_stars_are_whole(spark):
    words = [f"v{i}" for i in range(300)]
    # Each text is like the next only; the ends are unlike.
    texts = [" ".join(words[i : i + 100]) for i in range(0, 200, 5)]
    # Copies like the base, but hardly like each other.
    draw = random.Random(2)
    for i in range(25):
        copy = [f"b{j}" for j in range(200)]
        for j in draw.sample(range(200), 3):
            copy[j] = f"x{i}-{j}"
        texts.append(" ".join(copy))
    texts.append(" ".join(f"b{j}" for j in range(200)))
    df = docs(spark, texts)
    assert found(df, shingle_words=3, percent=85) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 3, 85)


def test_repeated_rows_null_keys_and_empty_tables(spark):
    df = docs(spark, ["one two three four", "one two three four", "one two three four", "five six seven", "five six seven"], ids=[4, 4, 9, None, None])
    assert found(df, shingle_words=3, percent=85) == sorted([(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 1, None, True), (None, 1, None, True)], key=repr)
    assert found(docs(spark, [])) == []
    assert found(docs(spark, [None, ""])) == [(0, 0, 0, True), (1, 0, 1, True)]


def test_documents_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(df, shingle_words=3, percent=85) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 3, 85)


def test_the_estimate_loses_hardly_any_pair():
    assert 1 <= least_overlap(80) < least_overlap(85) < 27


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0
