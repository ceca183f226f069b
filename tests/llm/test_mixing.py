import random

import pytest
from pyspark.sql import functions as F

from catalink.llm import mixing
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


def goals(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by stopping sources one after the other."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return stopped | {s: left * weight[s] / total for s in rest}
        for s in over:
            stopped[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(stopped.values())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")


def check(rows, mixed):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want, taken, largest = goals(sizes), dict.fromkeys(sizes, 0), {}
    got = mixed.collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(((k, s, n or 0) for k, s, n in rows), key=repr)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        ratio = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(ratio - 1e-9) <= r["copies"] <= int(ratio + 1 - 1e-9) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s
    return sorted((tuple(r) for r in got), key=repr)


def test_taken_words_come_near_the_targets(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["hot"] * 12 + ["b", "c", "É", "zz", "𝒳", None]), int(draw.paretovariate(1.1))) for i in range(6000)]
    rows += [(7000 + i, "tiny", 1) for i in range(3)] + [(8000, "zero", 0), (8001, "zero", None)]
    draw.shuffle(rows)
    first = check(rows, mixing.mix(table(spark, rows).withColumn("key", F.lit("x")).withColumn("rows", F.lit("y"))))
    again = check(rows, mixing.mix(table(spark, rows[::-1]).repartition(7)))
    assert first == again  # reruns agree, however the rows lie


def test_every_document_has_its_chance(spark):
    rows = [(i, "s" if i % 2 else "t", 10) for i in range(2000)]
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(table(spark, rows)).collect()}
    for half in (range(1000), range(1000, 2000)):  # t takes a quarter of its share, s three quarters, wherever their documents lie
        odd = sum(got[i] for i in half if i % 2) / 500
        even = sum(got[i] for i in half if not i % 2) / 500
        assert odd + even == pytest.approx(3, abs=0.2) and min(odd, even) == pytest.approx(1, abs=0.2)


def test_repeated_rows_null_keys_one_row_and_no_row(spark):
    rows = [(1, "a", 5)] * 900 + [(None, "a", 5)] * 500 + [(None, None, 3)] * 40 + [(2, None, 3)]
    check(rows, mixing.mix(table(spark, rows)))
    check([(1, "a", 7)], mixing.mix(table(spark, [(1, "a", 7)])))
    check([(1, None, 0)], mixing.mix(table(spark, [(1, None, 0)])))
    assert mixing.mix(table(spark, [])).count() == 0


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, "e": 700, None: 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(goals(sizes)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_word_counts(spark):
    texts = [None, "", "  ", "a", "a b\tc\nd\x0be\x0cf\rg", "a b c", " x "]
    got = docs(spark, texts).select("doc_id", mixing.word_count(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [0, 0, 0, 1, 7, 2, 1]


def test_take_repeats_and_drops_rows(spark):
    df = clashing(docs(spark, ["one two three"] * 5 + ["x"] * 4 + [None], ids=[1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))
    taken = mixing.take(df)
    assert taken.columns == df.columns
    words = sum(len((r["text"] or "").split()) for r in taken.collect())
    assert abs(words - 1.5 * 19) <= 3


def test_plans_have_no_python(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = mixing.take(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
