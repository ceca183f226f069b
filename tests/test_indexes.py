"""The stored vector index and the stored postings."""

import glob
import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalink import session
from catalink.operators import search
from catalink.sources import vector_index
from catalink.sources.postings import PostingsIndex
from catalink.sources.stores import BucketTable
from catalink.sources.vector_index import VectorIndex
from tests.conftest import SMALL
from tests.test_search import WORDS, best, brute_bm25, by_rank, frames, world  # noqa: F401
from workload.search_queries import corpus_questions, corpus_texts, corpus_vectors

LARGE = "/root/testdata/sf0.1"


def recall(exact, near):
    return sum(len(set(exact[q]) & set(near.get(q, []))) for q in exact) / sum(map(len, exact.values()))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(corpus_vectors(spark, LARGE), str(tmp_path_factory.mktemp("vectors")) + "/index", k=15)


def test_held_out_recall_and_vectors_read(spark, index):
    seen = {r["unit_id"] for r in spark.read.parquet(f"{index.path}/calibration").collect()}
    questions = corpus_questions(spark, LARGE).filter(~(F.col("question_id") * 5).isin(seen))
    asked = questions.count()
    assert asked >= 100 and index.settings["units"] == 2000
    reopened = VectorIndex(spark, index.path)
    exact = by_rank(search.vector_search(questions, corpus_vectors(spark, LARGE), 15))
    assert recall(exact, by_rank(reopened.search(questions, 15))) >= 0.95
    assert reopened.candidates(questions).count() < 0.25 * asked * index.settings["units"]


def test_new_units_need_no_training(spark, tmp_path):
    vectors = corpus_vectors(spark, SMALL)
    first = vectors.filter("unit_id % 2 = 0").withColumn("database_name", F.concat(F.lit("db"), (F.col("unit_id") % 4).cast("string")))
    built = VectorIndex.build(first, f"{tmp_path}/index", cells=8, buckets=3)
    trained = [os.path.getmtime(f) for f in sorted(glob.glob(f"{tmp_path}/index/c*/*.parquet"))]
    fresh = vectors.filter("unit_id % 2 = 1").withColumn("database_name", F.lit("db2"))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/index/entries/*/*/*.parquet")}
    built.replace(fresh, fresh.limit(1).unionByName(first.filter("database_name = 'db2'").limit(1)))
    assert trained == [os.path.getmtime(f) for f in sorted(glob.glob(f"{tmp_path}/index/c*/*.parquet"))]
    held = built.entries().groupBy("database_name").count().collect()
    assert {r["database_name"]: r["count"] for r in held} == {"db0": first.filter("database_name = 'db0'").count(), "db2": fresh.count()}
    kept = [f for f in before if os.path.exists(f)]
    assert {f.split("bucket=")[1][0] for f in before} - {f.split("bucket=")[1][0] for f in set(before) - set(kept)} or len(kept) < len(before)
    units = first.filter("database_name = 'db0'").unionByName(fresh)
    asked = units.filter("unit_id % 10 IN (0, 1)").select(F.col("unit_id").alias("question_id"), "database_name", "embedding")
    exact, near = by_rank(search.vector_search(asked, units, 5)), by_rank(VectorIndex(spark, f"{tmp_path}/index").search(asked, 5))
    assert recall(exact, near) >= 0.9 and all(near[q][0] == q for q in exact)
    built.replace(fresh.limit(0), fresh.select("database_name"))
    assert built.entries().filter("database_name = 'db2'").count() == 0
    assert by_rank(built.search(asked.filter("database_name = 'db2'"), 5)) == {}


def test_index_and_small_databases(spark, frames, world, tmp_path):  # noqa: F811
    units, questions = frames
    built = VectorIndex.build(units, f"{tmp_path}/index", k=6, buckets=4)
    exact, near = by_rank(search.vector_search(questions, units, 6)), by_rank(built.search(questions, 6))
    assert recall(exact, near) >= 0.95 and {q: len(x) for q, x in near.items()} == {q: len(x) for q, x in exact.items()}
    odd = questions.limit(3).withColumn("embedding", F.when(F.col("question_id") == 0, F.array(F.lit(1.0).cast("float"))))
    assert by_rank(built.search(odd, 6)) == {}
    with pytest.raises(ValueError):
        VectorIndex.build(units.limit(0), f"{tmp_path}/empty")


def test_codes_score_like_the_vectors_they_stand_for(spark, index):
    kernel_hits = index.candidates(corpus_questions(spark, LARGE).limit(5)).collect()
    centroids, book, parts = index.centroids, index.codebook, index.settings["parts"]
    stored = {r["unit_id"]: r for r in index.entries().collect()}
    asked = {r["question_id"]: np.array(r["embedding"], float) for r in corpus_questions(spark, LARGE).collect()}
    for r in kernel_hits[:200]:
        e, q = stored[r["unit_id"]], asked[r["question_id"]]
        width = book.shape[1] // parts
        shown = centroids[e["cell"]] + np.concatenate([book[c, p * width : (p + 1) * width] for p, c in enumerate(e["code"])])
        assert abs(q @ shown / np.linalg.norm(q) - r["score"]) < 1e-6


# ---- postings


def test_postings_equal_the_exact_search(spark, frames, world, tmp_path):  # noqa: F811
    units, questions = frames
    index = PostingsIndex(spark, f"{tmp_path}/postings", 3)
    index.replace(units, text=F.col("text"))
    for k in (1, 6, 40):
        assert by_rank(index.search(questions, k)) == brute_bm25(*world, k)
    got = {(r["question_id"], r["unit_id"]): r["score"] for r in index.search(questions, 6).collect()}
    want = {(r["question_id"], r["unit_id"]): r["score"] for r in search.keyword_search(questions, units, 6, F.col("text")).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)


def test_the_units_of_one_database_do_not_meet_in_one_task(spark, tmp_path, monkeypatch):
    """Neither where its few totals are sent to the units nor where they are merged; without broadcasts left to Spark."""
    units = spark.createDataFrame([(f"u{i}", "d", "one two " * (i % 9)) for i in range(50)], "unit_id string, database_name string, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (20_000, 0):
            written = []
            monkeypatch.setattr(session, "SENT_ROWS", rows)
            monkeypatch.setattr(BucketTable, "replace", lambda self, fresh, replaced: written.append(fresh))
            PostingsIndex(spark, f"{tmp_path}/postings").replace(units, text=F.col("text"))
            plan = written[0]._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(database_name" in plan and not re.search(r"hashpartitioning\(database_name#\d+, \d+\)", plan), plan
            assert ("Broadcast" in plan) == (rows > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_blocks_are_skipped_and_nothing_is_lost(spark, tmp_path):
    texts, questions = corpus_texts(spark, "/root/testdata/sf0.01"), corpus_questions(spark, "/root/testdata/sf0.01")
    index = PostingsIndex(spark, f"{tmp_path}/postings", 2)
    index.replace(texts, text=F.col("text"))
    assert by_rank(index.search(questions, 5)) == by_rank(search.keyword_search(questions, texts, 5, F.col("text")))
    skipped, total = index.skipped(questions, 5)
    assert 0 < skipped < total


def test_replacing_a_database_rewrites_only_its_postings(spark, frames, world, tmp_path):  # noqa: F811
    units, questions = frames
    index = PostingsIndex(spark, f"{tmp_path}/postings", 16)
    index.replace(units, text=F.col("text"))

    def stamp():
        return {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/postings/postings/*/*.parquet")}

    before = stamp()
    changed = units.filter("database_name = 'db3'").withColumn("text", F.concat("text", F.lit(" film zyzzyva")))
    index.replace(changed, text=F.col("text"))
    assert len({os.path.dirname(f) for f in set(before) - set(stamp())}) == 1  # the bucket of db3
    rest = [u if u[1] != "db3" else (u[0], u[1], u[2] + " film zyzzyva", u[3]) for u in world[0]]
    assert by_rank(index.search(questions, 6)) == brute_bm25(rest, world[1], 6)
    index.delete(spark.createDataFrame([("hot",)], "database_name string"))
    assert by_rank(index.search(questions, 6)) == brute_bm25([u for u in rest if u[1] != "hot"], world[1], 6)


def test_empty_texts_and_no_questions(spark, tmp_path):
    schema = "unit_id string, database_name string, text string"
    units = spark.createDataFrame([("a", "d", None), ("b", "d", ""), ("c", "d", "one two two")], schema)
    index = PostingsIndex(spark, f"{tmp_path}/postings")
    index.replace(units, text=F.col("text"))
    asked = spark.createDataFrame([(1, "d", "two three"), (2, "d", None), (3, "e", "two"), (4, "d", " ")], "question_id int, database_name string, question string")
    assert by_rank(index.search(asked, 3)) == {1: ["c"]} == by_rank(search.keyword_search(asked, units, 3, F.col("text")))
    assert by_rank(index.search(asked.limit(0), 3)) == {}


def test_scores_are_held_in_slices():
    rng, parts = np.random.default_rng(3), 2
    kernel = vector_index.CodeKernel(rng.normal(size=(3, 8)), rng.normal(size=(256, 8)), parts)
    questions = pa.table({"embedding": pa.array(rng.normal(size=(1_000, 8)).tolist())})
    units = pa.table({"cell": np.ones(5_000, np.int32), "code": pa.array([bytes(c) for c in rng.integers(0, 256, (5_000, parts), np.uint8)])})
    found = list(kernel(questions, units)(np.arange(1_000), np.arange(5_000)))
    assert np.concatenate([rows for rows, _ in found]).tolist() == list(range(1_000))
    assert max(scores.size for _, scores in found) <= vector_index.CELLS
    x, entries = rng.normal(size=(10_000, 8)), rng.normal(size=(2_048, 8))
    tracemalloc.start()
    near = vector_index.nearest(x, entries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 8 * vector_index.CELLS
    assert near[::997].tolist() == [int(((v - entries) ** 2).sum(1).argmin()) for v in x[::997]]
    assert len(vector_index.nearest(x[:0], entries)) == 0
