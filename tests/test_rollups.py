import random

import pytest
from pyspark.sql import functions as F

from catalink.operators import rollups

SCHEMA = "day string, dialect string, complexity string, sql string, passed boolean, overall_score int, referenced_tables array<string>, queries int"


def log(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).withColumn("day", F.col("day").cast("date"))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = []
    for i in range(20_000):
        hot = i % 3 == 0  # a third of all rows on one day and dialect
        day = "2024-01-15" if hot else f"2024-0{draw.randint(1, 3)}-{draw.randint(1, 28):02d}"
        out.append((day, "mysql" if hot else draw.choice(["oracle", None]), "easy", f"SELECT {draw.randint(0, 6000)}", i % 2 == 0,
                    min(100, int(draw.expovariate(0.02))), draw.sample([f"t{n}" for n in range(300)], draw.randint(0, 3))))
    return out


def test_spans_of_kept_days_against_exact_values(spark, rows, tmp_path):
    path = str(tmp_path / "days")
    rollups.write(rollups.daily(log(spark, rows)), path)
    for first, last in (("2024-01-01", "2024-03-31"), ("2024-01-15", "2024-01-15"), ("2024-02-10", None), (None, "2024-01-20")):
        merged = rollups.merge(rollups.span(spark, path, first, last), "dialect")
        inside = [r for r in rows if (first or "") <= r[0] <= (last or "9")]
        for got in rollups.summary(merged, "dialect", quantiles=(0.05, 0.5, 0.99)).collect():
            own = [r for r in inside if r[1] == got.dialect]
            assert (got.queries, got.passed) == (len(own), sum(r[4] for r in own))
            assert got.mean_score == pytest.approx(sum(r[5] for r in own) / len(own))
            for told, exact in ((got.statements, len({r[3] for r in own})), (got.tables, len({t for r in own for t in r[6]}))):
                assert abs(told - exact) <= (rollups.DISTINCT_ERROR * exact if exact >= 2**rollups.THETA_BITS else 0)
            for q, value in zip((0.05, 0.5, 0.99), got.score_quantiles):
                below, upto = (sum(f(r[5]) for r in own) / len(own) for f in (lambda s: s < value, lambda s: s <= value))
                assert below - rollups.RANK_ERROR <= q <= upto + rollups.RANK_ERROR
        assert {r[1] for r in inside} == {r.dialect for r in merged.select("dialect").collect()}


def test_merging_in_steps_is_merging_at_once(spark, rows):
    days = rollups.daily(log(spark, rows))
    steps = rollups.merge(rollups.merge(days, "day", "dialect"), F.month("day").alias("month"))
    told = lambda df: [tuple(r)[:4] for r in rollups.summary(df.select(F.lit(0).alias("k"), "*"), "queries").collect()]
    assert told(rollups.merge(steps)) == told(rollups.merge(days))


def test_a_day_that_is_rolled_up_again_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "days")
    one = ("2024-05-01", "mysql", "easy", "SELECT 1", True, 100, ["a"])
    rollups.write(rollups.daily(log(spark, [one, ("2024-05-02", *one[1:])])), path)
    rollups.write(rollups.daily(log(spark, [("2024-05-02", *one[1:]), ("2024-05-02", "mysql", "easy", "SELECT 2", False, 50, ["b"])])), path)
    got = rollups.summary(rollups.merge(rollups.span(spark, path), "day"), "day").orderBy("day").collect()
    assert [(str(r.day), r.queries, r.passed, r.statements, r.tables) for r in got] == [("2024-05-01", 1, 1, 1, 1), ("2024-05-02", 2, 1, 2, 2)]
    rollups.write(rollups.daily(log(spark, [("2024-06-01", *one[1:])])), path)
    assert rollups.span(spark, path).select("day").distinct().count() == 3
    plan = rollups.span(spark, path, "2024-05-02", "2024-05-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-05" in plan.split("PartitionFilters")[1].split("]")[0]


def test_nulls_empty_and_repeated_rows(spark, tmp_path):
    rows = [
        (None, None, None, None, None, None, None), ("2024-05-01", "x", "easy", "", True, 100, []),
        ("2024-05-01", "x", "easy", "S" * 300_000, False, None, ["a", None, "a"]), ("2024-05-01", "x", "easy", "", True, 100, []),
    ]
    path = str(tmp_path / "days")
    rollups.write(rollups.daily(log(spark, rows)), path)
    got = {r.dialect: r for r in rollups.summary(rollups.merge(rollups.span(spark, path), "dialect"), "dialect", quantiles=(0.5,)).collect()}
    empty, some = got[None], got["x"]
    assert (empty.queries, empty.passed, empty.mean_score, empty.statements, empty.tables, empty.score_quantiles) == (1, 0, None, 0, 0, None)
    assert (some.queries, some.passed, some.mean_score, some.statements, some.tables, some.score_quantiles) == (3, 2, 100.0, 2, 1, [100])
    assert rollups.merge(rollups.daily(log(spark, [])), "dialect").count() == 0
